import pyarrow as pa
from conftest import SF_SMALL
from llm_cases import docs_frame

from newsflux.llm import op6_decontaminate as op6

ITEM = ("Yesterday Alice bought 12 red apples and 7 green pears at the small market near Paris, and then Alice gave "
        "5 apples to her friend before walking 3 miles home.")
OTHER = "Solve for the unknown value when twice the sum of both terms equals the final result of step four."
ITEMS = [(1, ITEM), (2, OTHER), (3, "too short item"), (4, None), (5, "one two three four five six seven"), (2, OTHER)]

FILL = " ".join(f"filler{i}" for i in range(40))


def found(spark, texts, items=ITEMS):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op6.leaks(docs_frame(spark, list(enumerate(texts))), bench).collect()
    return {(r.doc_id, r.item_id): r.verbatim for r in got}


def test_cases(spark):
    renamed = ITEM.replace("Alice", "Berta").replace("12", "31").replace("7", "44").replace("Paris", "Rome").replace("miles", "km")
    swapped = ITEM.replace("Alice", "Berta", 1)  # one Alice became another person: inconsistent
    far = " ".join(w if i % 4 else f"z{i}" for i, w in enumerate(OTHER.split()))
    texts = [
        f"{FILL} {ITEM} {FILL}",                                 # 0 verbatim
        f"{FILL} {renamed} {FILL}",                              # 1 re-parameterised
        f"{FILL} {ITEM.lower()} {FILL}",                         # 2 case changed
        f"{FILL} {OTHER.replace(' ', '  ' + chr(10))} {FILL}",   # 3 white space changed
        f"{FILL} {far} {FILL}",                                  # 4 every fourth word replaced
        FILL, None, "", " \n",                                   # 5-8 nothing
        "Too short item!",                                       # 9 a short item word for word
        f"{FILL} {' '.join(OTHER.split()[:10])} {FILL}",         # 10 ten words only
        f"{FILL} {' '.join(OTHER.split()[:14])} {FILL}",         # 11 fourteen words
        f"{FILL} One, two; three four (five) six seven! {FILL}",  # 12 a whole short item: other numbers would do too
        f"{'pad ' * 60000}{OTHER}",                              # 13 very long text
        f"{OTHER} {FILL} {ITEM}",                                # 14 two items
        f"{FILL} {swapped} {FILL}",                              # 15 verbatim parts of an inconsistent copy
    ]
    got = found(spark, texts)
    pairs = set(got)
    assert {(0, 1), (1, 1), (2, 1), (3, 2), (11, 2), (13, 2), (14, 1), (14, 2)} <= pairs
    assert got[0, 1] and not got[1, 1] and got[3, 2]
    assert not {d for d, _ in pairs} & {4, 5, 6, 7, 8, 10}
    assert (9, 3) in pairs and pairs - {(9, 3)} <= {(0, 1), (1, 1), (2, 1), (3, 2), (11, 2), (13, 2), (14, 1), (14, 2), (12, 5), (15, 1)}


def test_slots_must_be_consistent(spark):
    item = "the price of 3 small items and 5 large items is 3 coins more than the price of 8 items"
    same = item.replace("3", "7").replace("5", "9")
    mixed = "the price of 7 small items and 9 large items is 6 coins more than the price of 8 items"
    assert set(found(spark, [f"{FILL} {same} {FILL}", f"{FILL} {mixed} {FILL}"], [(1, item)])) == {(0, 1)}


def test_items_full_of_numbers_are_found_word_for_word(spark):
    texts = ["A train travels 120 miles in 2 hours and then 180 miles in 3 hours. What is its average speed?",
             "Tom ran 5 km on day 1, 7 km on day 2 and 9 km on day 3. How far did Tom run?",
             "Convert 3 hours 25 minutes 40 seconds to seconds.", "What is 12 plus 30 minus 4 times 7?"]
    items = list(enumerate(texts))
    other = [t.replace("3", "8").replace("12", "15") for t in texts]  # too few literals to tell a template by
    got = found(spark, [f"{FILL} {t} {FILL}" for t in texts] + [f"{FILL} {t.upper()} {FILL}" for t in texts]
                + [f"{FILL} {t} {FILL}" for t in other[2:]], items)
    assert got == {(d, d % 4): True for d in range(8)}


def test_rows_without_leaks_stay(spark):
    rows = [(1, f"{FILL} {ITEM}"), (2, FILL), (2, FILL), (1, FILL), (None, f"{OTHER} x"), (None, None), (6, "")]
    docs = docs_frame(spark, rows)
    out = op6.drop_contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(2, FILL), (2, FILL), (1, FILL), (None, None), (6, "")], key=repr)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op6.leaks(docs_frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert op6.leaks(docs_frame(spark, [(1, ITEM)]), none).count() == 0


def test_query_finds_all_embedded_items(spark):
    from newsflux.llm.queries import QUERIES
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    embedded = {(d.doc_id, i.item_id) for d in docs for i in items if i.text.lower() in (d.text or "").lower()}
    assert got == embedded and embedded


def test_template_words():
    text = pa.array(['"Über 3.5 kg, (Five) O\'Neil -- it\'s'])
    (_, data, offsets), = op6.C.text_blocks(text)
    value, kind, first = op6._template(data, offsets)
    assert kind.tolist() == [op6._NAME, op6._NUMBER, op6._UNIT, op6._NUMBER, op6._NAME, 0] and first.tolist() == [0, 6]
    lower, _, _ = op6._template(*[(d, o) for _, d, o in op6.C.text_blocks(pa.array(["über 3.5 KG five o'neil it's"]))][0])
    assert (value == lower).all()


def test_names_and_quantities_of_several_words(spark):
    item = "On Monday Natalia sold 48 clips to friends in the old town and then sold half as many clips in May after lunch"
    texts = [item.replace("Natalia", "Mary Ann"), item.replace("Natalia", "Maria").replace("48", "twenty two"),
             item.replace("Natalia", "Mary Ann van").replace("clips", "books")]
    got = found(spark, [f"{FILL} {t} {FILL}" for t in texts] + [f"{FILL} {item} {FILL}"], [(1, item)])
    assert set(got) == {(0, 1), (1, 1), (3, 1)} and got[3, 1]


def test_short_items_and_scripts_without_blanks(spark):
    chinese = "小明有三个苹果他给了小红两个然后又买了五个苹果请问小明现在一共有几个苹果"
    items = [(1, "Solve x plus 3"), (2, chinese), (3, "Yes"), (4, "the cat"), (5, "Supercalifragilistic!"), (6, "東京の首都は")]
    texts = [f"{FILL} solve X plus 3. {FILL}", f"{FILL} solve x plus 4 {FILL}", f"前文{chinese}后文", f"{FILL} {chinese} {FILL}",
             chinese[:12] + "别的内容", "Yes the cat", "a (supercalifragilistic) b", "東京の首都は" * 3, chinese[:20]]
    assert set(found(spark, texts, items)) == {(0, 1), (2, 2), (3, 2), (6, 5), (8, 2)}


def _plain_windows(text, n):
    """Windows of template words in plain Python: (template, values) by the first word's number, with names."""
    import re
    words = [w for w in (re.sub(r"^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", w) for w in text.split()) if w]
    kinds = ["#" if w[0].isdigit() or w.lower() in op6.NUMBER_WORDS else "u" if w.lower() in op6.UNITS else "N" if w[0].isupper() else ""
             for w in words]
    runs = []
    for w, k in zip(words, kinds, strict=True):
        if k and runs and runs[-1][0] == k:
            runs[-1][1].append(w.lower())
        else:
            runs.append((k, [w.lower()]))
    for i in range(len(runs) - n + 1):
        part = runs[i:i + n]
        if sum(not k for k, _ in part) * 1000 >= op6.MIN_LITERAL * n:
            yield i, tuple(k or w[0] for k, w in part), [(k, " ".join(w)) for k, w in part if k], len(runs)


def _plain_template_leak(item, text):
    """Does one consistent alignment of item and text cover enough of the item, by the reading with names?"""
    from collections import defaultdict
    n = op6.WINDOW
    where = defaultdict(list)
    for i, t, slots, _ in _plain_windows(text, n):
        where[t].append((i, slots))
    met = defaultdict(list)
    for i, t, slots, total in _plain_windows(item, n):
        for j, other in where[t]:
            met[j - i].append((i, slots, other))
    for rows in met.values():
        pairs = {p for _, a, b in rows for p in zip(a, b, strict=True)}
        names = {p for p in pairs if p[0][0] == "N"}
        if len({a for a, _ in pairs}) == len(pairs) and len({b for _, b in names}) == len(names):
            if len({i + k for i, _, _ in rows for k in range(n)}) >= min(op6.MIN_COVERED, total):
                return True
    return False


def test_templates_equal_a_plain_matcher(spark):
    import random
    rng = random.Random(6)
    rest = "went to the shop and bought some bread for dinner while the others stayed at home with a book near fire".split()
    slot = lambda: rng.choice(["Alice", "Bob Lee", "Carla", "7", "12", "four", "miles", "kg", "Paris"])

    def sentence():
        return [rng.choice(rest) if rng.random() < 0.8 else slot() for _ in range(rng.randint(18, 26))]

    items = [sentence() for _ in range(12)]
    texts = []
    for words in items:
        for _ in range(6):
            new = {w: rng.choice([w, slot()]) for w in words if w not in rest}
            got = [new.get(w, w) if rng.random() < 0.97 else slot() for w in words]
            cut = rng.randint(0, 8)
            texts.append(f"{FILL} {' '.join(got[cut:])} {FILL}")
    want = {(d, i) for d, t in enumerate(texts) for i, w in enumerate(items) if _plain_template_leak(" ".join(w), t)}
    got = set(found(spark, texts, [(i, " ".join(w)) for i, w in enumerate(items)]))
    assert len(want) > 20 and want <= got  # the other readings may find more
