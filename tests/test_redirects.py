import random

from newsflux.operators import redirects as R


def follow(step, url):
    n, at, seen = 0, url, {url}
    while at in step:
        at, n = step[at], n + 1
        if at in seen:
            return None, None
        seen.add(at)
    return at, n


def test_chains_circles_and_trees(spark):
    rng = random.Random(4)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(70)]                      # one long chain
    pairs += [(f"o{i}", f"o{(i + 1) % 5}") for i in range(5)] + [("self", "self")]  # circles
    pairs += [(f"in{i}", "o2") for i in range(3)] + [("far", "in1")]              # ways into a circle
    pairs += [(f"hot{i}", "login") for i in range(300)] + [("login", "home")]      # many to one
    pairs += [(f"r{i}", f"r{rng.randrange(80)}") for i in range(60)]
    pairs += [("two", "b"), ("two", "a"), (None, "x"), ("x", None), ("c3", "c4")]
    df = spark.createDataFrame(pairs, "url string, target string")
    step = {}
    for u, t in pairs:
        if u is not None and t is not None:
            step[u] = min(t, step.get(u, t))
    got = {r.url: (r.final_url, r.hops) for r in R.final_urls(df).collect()}
    assert got == {u: follow(step, u) for u in step}
    assert R.final_urls(df.where("false")).count() == 0


def test_requests_keep_their_url_beside_the_final_one(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("l", "l")], "url string, target string")
    asked = spark.createDataFrame([(1, "a"), (2, "c"), (3, "l"), (4, None), (5, "a")], "id int, url string")
    got = sorted(map(tuple, R.with_final(asked, hops).select("id", "url", "final_url", "looped").collect()))
    assert got == [(1, "a", "c", False), (2, "c", "c", False), (3, "l", None, True), (4, None, None, False), (5, "a", "c", False)]
