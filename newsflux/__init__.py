"""newsflux: financial-news data jobs on Spark (see README.md)."""
