"""User-facing profile state as batch jobs over logs.

The reference mutates one user document per console action. Here every
action is a row of a log and the profile is a function of the log, so the
same code serves a backfill and an incremental run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import scratch_path
from . import keyed
from .ordering import number_within, top_within

# --- fixed values -----------------------------------------------------------
HISTORY_CAP = 50                 # reading-history length
PRICE_LABEL = "当前价格："        # quote report: current price
CHANGE_LABEL = "跌涨幅："         # quote report: change
# -----------------------------------------------------------------------------


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a join on it sees plain
    files, so AQE can split a hot key, and the lineage of a loop stays short."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def register(signups: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """M1: outcome code per signup in log order: 1 inserted, -3 username
    taken, -4 email taken.

    A signup succeeds when neither its username nor its email belongs to an
    earlier success. NULL is a value like any other: a lookup of a missing field
    finds the profiles that miss it too, so one profile may lack an email (or a
    username) and the next signup without it is rejected.

    That is decided in rounds over the distinct (username, email) pairs, each by
    its first signup: open pairs that are the first of both their username and
    their email succeed, pairs that share a username or an email with a success
    are closed, until none is open. A round stores two tables, the first signup of
    every name (one ``min`` aggregate, combined map-side) and the pairs it judged;
    no connected component of names is ever gathered. The first open pair always
    succeeds, so the rounds end (a round without a success raises); a log where
    each username keeps its email needs two.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    keyed_ = signups.withColumns({"_user": key("username"), "_mail": key("email")})
    when = F.struct(*[F.col(c) for c in order], F.col("_user"), F.col("_mail"))
    open_ = keyed_.groupBy("_user", "_mail").agg(F.min(when).alias("_at"))
    won = None
    while True:
        names = A.explode_rows(open_, F.array(F.struct(F.lit("user").alias("kind"), F.col("_user").alias("name")),
                                              F.struct(F.lit("mail").alias("kind"), F.col("_mail").alias("name"))), "n", "_at")
        firsts = _stored(names.groupBy("n.kind", "n.name").agg(F.min("_at").alias("first")), "register-firsts")
        of = lambda kind: firsts.where(F.col("kind") == kind).select(F.col("name").alias(f"_{kind}"), F.col("first").alias(f"_{kind}_at"))
        judged = _stored(open_.join(of("user"), "_user").join(of("mail"), "_mail")
                         .select("_user", "_mail", "_at", (F.col("_at").eqNullSafe(F.col("_user_at"))
                                                           & F.col("_at").eqNullSafe(F.col("_mail_at"))).alias("_won")), "register-judged")
        counts = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("_won").alias("won")).first()
        if counts["n"] > 0 and counts["won"] == 0:
            raise RuntimeError("registration: a round closed no signup")
        wins = judged.where("_won").drop("_won")
        won = wins if won is None else won.unionByName(wins)
        if counts["n"] == counts["won"]:
            break
        open_ = (judged.where("NOT _won").drop("_won").join(wins.select("_user"), "_user", "left_anti")
                 .join(wins.select("_mail"), "_mail", "left_anti"))
    winners = won.select("_user", F.col("_mail").alias("_won_mail"), F.col("_at").alias("_won_at"))
    code = (F.when((F.col("_won_at") == when) & (F.col("_won_mail") == F.col("_mail")), 1)
            .when(F.col("_won_at") < when, -3).otherwise(-4))
    return keyed_.join(winners, "_user", "left").select(*signups.columns, code.cast("int").alias("code"))


def profiles_from(registrations: DataFrame) -> DataFrame:
    """Successful registrations -> profile rows (username, email)."""
    return registrations.where(F.col("code") == 1).select("username", "email")


def recent_reads(reads: DataFrame, user: str = "user_id", order=("ts", "event_id"),
                 cap: int = HISTORY_CAP) -> DataFrame:
    """The newest ``cap`` reads per user, newest first (pos 1)."""
    return top_within(reads, [user], [F.col(c).desc() for c in order], cap)


def tag_set(tags: DataFrame, user: str = "user_id", tag: str = "tag") -> DataFrame:
    """Distinct tags per user in code-point order."""
    return tags.groupBy(user).agg(F.array_sort(F.collect_set(tag)).alias("tags"))


def replay_last_action(actions: DataFrame, keys, order, action: str = "action") -> DataFrame:
    """M6: final state of a (user, item) add/delete log: the last action wins."""
    last = keyed.last_per_key(actions.select(*keys, *order, action), keys, order)
    return last.where(F.col(action) == "add").select(*keys)


def stock_lookup(probes: DataFrame, stocks: DataFrame, q: str = "q") -> DataFrame:
    """A probe starting with sz/sh is a code, else an exact name; names
    shared by several stocks resolve to the lowest code. No match -> no row.

    One join: codes and names are keys of one stored table (names that look like
    codes can never match, so they are no keys)."""
    names = (stocks.where(~(F.col("name").startswith("sz") | F.col("name").startswith("sh")))
             .groupBy(F.col("name").alias(q)).agg(F.min("code").alias("code")))
    keys = stocks.select(F.col("code").alias(q), "code").unionByName(names)
    return probes.join(_stored(keys, "stock-keys"), q)


def quote_report(pos, name, current, delta, percent):
    """``"{i}. {name}\n<price>{cur:.2f}\t<change>{delta:+.2f} ({pct:+.2f})%"``."""
    from ..functions import text as T
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(c(pos).cast("string"), F.lit(". "), c(name),
                    F.lit("\n" + PRICE_LABEL), T.fmt2(c(current)),
                    F.lit("\t" + CHANGE_LABEL), T.fmt2_signed(c(delta)),
                    F.lit(" ("), T.fmt2_signed(c(percent)), F.lit(")%"))


def watchlist(adds: DataFrame, user: str = "user_id", at: str = "added_at", seq=()) -> DataFrame:
    """A user's stocks in add order with 1-based positions; adds of one
    instant keep their arrival order ``seq``."""
    return number_within(adds, [user], [at, *seq], name="pos")
