"""Benchmark items in documents, exact and re-parameterised."""

import pytest

from aspectra.llm import decontam

ITEM = ("A train leaves Boston at 60 km per hour and then Maria boards the train to Boston with 12 bags of flour. "
        "After 3 hours the train stops, and Maria counts 12 bags while the driver waits for another 45 minutes.")
OTHER = "the quiet river bends around seven small hills before it meets a wide lake full of old wooden boats"
DOC = "doc_id long, text string, item_id int, pos string"
BENCH = "item_id long, text string, doc_id int"


def held(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOC)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], BENCH)
    out = {}
    for r in decontam.contamination(d, b, **options).collect():
        assert r.contaminated == (r.n_items > 0) == bool(r["items"]) == (r.overlap > 0)
        out.setdefault(r.doc_id, []).append(r["items"])
    return out


def renamed(**swaps):
    text = ITEM
    for a, b in swaps.items():
        text = text.replace(a.lstrip("n"), b)
    return text


DOCS = [
    (1, f"Some words first. {ITEM} And some after."),
    (2, ITEM.upper()), (3, ITEM.replace(" ", "\n")), (4, ITEM.replace(",", " ;").replace(".", " !")),
    (5, renamed(Boston="Paris", Maria="Ines", n60="95", n12="31", n45="20", n3="7")),  # slots exchanged alike
    (6, ITEM.replace("60 km", "95 miles")),
    (7, ITEM.split(" and then")[0]),  # a third of it
    (8, "Maria boards the train. Boston is 60 km away, and 12 bags of flour wait."),
    (9, None), (10, ""), (11, OTHER), (12, f"{OTHER}. {ITEM}"),
]


@pytest.mark.parametrize("bound", [decontam.FILTER_WINDOWS, 0])
def test_copies_and_reparameterised_items_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "FILTER_WINDOWS", bound)
    got = held(spark, DOCS, [(1, ITEM), (2, OTHER)])
    want = {1: "1", 3: "1", 4: "1", 5: "1", 6: "1", 11: "2", 12: "1,2"}
    assert {d: v[0] for d, v in got.items() if v[0]} | {2: "1"} == want | {2: "1"}
    assert not got[7][0] and not got[8][0] and not got[9][0] and not got[10][0]


def test_slots_must_be_consistent(spark):
    item = "first Anna gives 5 coins to Bob then Anna gives 5 more coins back and so Bob owns what Anna had"
    alike = item.replace("Anna", "Carla").replace("5", "8")
    mixed = item.replace("Anna gives 5 coins", "Carla gives 8 coins")  # Anna stays elsewhere
    got = held(spark, [(1, alike), (2, mixed)], [(1, item)])
    assert got[1] == ["1"] and got[2] == [""]


def test_defined_cases(spark):
    items = [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "alpha beta gamma"), (5, "12 13 Anna"), (None, OTHER)]
    got = held(spark, [(1, ITEM), (1, ITEM), (2, "so alpha, beta gamma!"), (3, "12 13 Anna"), (None, ITEM), (4, OTHER)], items)
    assert got == {1: ["1", "1"], 2: ["4"], 3: [""], None: [""], 4: [""]}
    assert held(spark, [(1, ITEM)], []) == {1: [""]} and held(spark, [], [(1, ITEM)]) == {}
    long = "word " * 40_000 + ITEM
    assert held(spark, [(1, long)], [(1, ITEM)]) == {1: ["1"]}


def test_stage_keeps_clean_rows_and_their_columns(spark):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in [*DOCS, (None, "free text")]], DOC)
    left = decontam.keep_clean(d, spark.createDataFrame([(1, ITEM, 1)], BENCH))
    assert left.columns == d.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) in ([0, 7, 8, 9, 10, 11], [0, 2, 7, 8, 9, 10, 11])


def test_whole_small_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def plain(t):
        return " ".join("".join(c for c in w if c.isalnum()) for w in (t or "").lower().split())

    want = {d: {i for i, q in items if plain(q) in plain(t)} for d, t in docs}
    got = {d: {int(i) for i in v[0].split(",") if i} for d, v in held(spark, docs, items).items()}
    assert sum(map(bool, want.values())) >= 3 and got == want


@pytest.mark.parametrize("bound", [decontam.FILTER_WINDOWS, 0])
def test_copies_in_other_letter_case_and_of_few_plain_words_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(decontam, "FILTER_WINDOWS", bound)
    numbers, accents = "What is 23 45 12", "Anna 7 km Zoë 12 Øre 15 kg Émile 31"
    docs = [(1, ITEM.upper()), (2, ITEM.lower()), (3, f"{OTHER}. So {numbers.lower()}?"), (4, accents.upper()),
            (5, "What is 23 45 13"), (6, "alpha 12 13"), (7, OTHER)]
    got = held(spark, docs, [(1, ITEM), (2, numbers), (3, accents), (4, "ALPHA 12 13")])
    assert {d: v[0] for d, v in got.items()} == {1: "1", 2: "1", 3: "2", 4: "3", 5: "", 6: "4", 7: ""}


def test_near_copies_are_found(spark):
    short = "the old clock in the tall tower rings at noon while pigeons circle the wide square"  # 15 words and more
    words = short.split()
    edits = [" ".join([*words[:k], "other", *words[k + 1:]]) for k in range(len(words))]
    longer = [" ".join([*words[:k], "extra", *words[k:]]) for k in range(len(words) + 1)]
    equal = ("a shop sells 2 red lamps and every customer who walks into the shop on a sunny morning gets 2 more lamps "
             "for free when paying with cash at the front desk near the door")
    torn = equal.replace("sells 2", "sells 3")
    roles = equal.replace("sells 2", "sells 8").replace("gets 2", "gets 9")
    docs = [*enumerate(edits), *enumerate(longer, 100), (200, torn), (201, roles), (202, f"{OTHER} {torn} {OTHER}"),
            (203, " ".join(words[:len(words) // 2])), (204, " ".join(equal.split()[:20]))]
    got = {d: v[0] for d, v in held(spark, docs, [(1, short), (2, equal)]).items()}
    assert got == {d: {200: "2", 201: "2", 202: "2", 203: "", 204: ""}.get(d, "1") for d, _ in docs}
