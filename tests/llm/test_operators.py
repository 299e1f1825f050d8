"""Each operator on odd tables, and against brute force where SQL can't express it."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, decontaminate, divergence, html_region, jaccard_join, maglev, preference, scratch, token_counts, wavelet, weak_label

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
known = pytest.importorskip("public_tokenizers")


def odd_table(spark):
    """Nulls in every column, empty and long texts, repeated rows, equal ids."""
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 3),
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 3),
        (2, None, None, None, None),
        (None, "null id text of some words here and there", None, "b", 1),
        (3, "", "en", "b", 0),
        (4, "   \n\t ", "fr", "b", 5),
        (5, long, "en", "c", len(long)),
        (6, "x" * 40_000, "", "c", 1),
        (7, "日本語 текст 🙂🙂 <|endoftext|> don't", "ja", "c", 9),
        (7, "same id other text", "en", "c", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with the names that the operators use for their own."""
    for c in ("kept", "score", "found", "f", "slot", "_key", "n_tokens", "cls", "key", "bands", "toks", "h", "ref_lang"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def docs(spark, sf):
    return scratch.read(spark, sf, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


TABLES = {
    "op1": lambda d: decontaminate.leaks(d, d.sparkSession.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "short")], "item_id long, text string")),
    "op2": token_counts.count_tokens,
    "op3": jaccard_join.links,
    "op4": weak_label.score_table,
    "op6": divergence.rule_table,
    "op7": maglev.place,
    "op8": byte_bpe.round_trip,
    "op10": wavelet.write_and_read,
}
ROW_PER_DOCUMENT = {k for k in TABLES if k != "op1"}


@pytest.mark.parametrize("name", TABLES)
def test_odd_rows(spark, name):
    d = odd_table(spark)
    n = TABLES[name](d).count()
    assert n == d.count() if name in ROW_PER_DOCUMENT else n == 0


@pytest.mark.parametrize("name", TABLES)
def test_extra_columns_change_nothing(spark, name):
    d = odd_table(spark)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(TABLES[name](clashing(d))) == key(TABLES[name](d))


@pytest.mark.parametrize("name", TABLES)
def test_empty_table(spark, name):
    assert TABLES[name](spark.createDataFrame([], DOCS)).count() == 0


STAGES = {
    "rules": divergence.apply_rules,
    "classifier": weak_label.apply_classifier,
    "duplicates": jaccard_join.deduplicate,
    "decontamination": lambda d: decontaminate.apply_decontamination(d, d.sparkSession.createDataFrame([(1, "a b c")], "item_id long, text string")),
}


def test_encoding_as_a_stage(spark):
    d = odd_table(spark)
    out = byte_bpe.round_trip(clashing(d))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == d.count()


@pytest.mark.parametrize("name", STAGES)
def test_stages_pass_all_columns(spark, name):
    d = clashing(odd_table(spark))
    out = STAGES[name](d)
    assert out.columns == d.columns
    assert STAGES[name](spark.createDataFrame([], d.schema)).count() == 0


# ---------------------------------------------------------------- 1
ITEM = "On a sunny day when Alice walks along the river for 12 km in 3 hours, how far does Alice walk in 8 hours at that same steady pace?"


def leak(spark, text, item=ITEM):
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return decontaminate.leaks(d, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()


def test_verbatim_and_other_case(spark):
    for text in (ITEM, f"before it. {ITEM} and after", f"BEFORE. {ITEM.upper()}!!", ITEM.replace(" ", "  %%% ")):
        assert [r["kind"] for r in leak(spark, text)] == ["verbatim"]


def test_reparameterised_consistently(spark):
    other = ITEM.replace("Alice", "Bob").replace("12", "20").replace("3 h", "5 h").replace("8 h", "9 h")
    r = leak(spark, other)
    assert [x["kind"] for x in r] == ["reparameterised"] and r[0]["changed_slots"] == 4


def test_inconsistent_slots_are_no_leak(spark):
    assert leak(spark, ITEM.replace("far does Alice", "far does Bob")) == []


def test_common_words_are_no_leak(spark):
    assert leak(spark, "How far does one walk in a day if the pace is kept and the road is good?") == []


@pytest.mark.parametrize("before", ["", "Quoted: \"", "One line.\n"])
def test_names_that_begin_sentences(spark, before):
    item = "Tom has 5 red apples. Tom gives 2 apples to Ann. How many does Tom keep now?"
    r = leak(spark, before + item.replace("Tom", "Sam"), item)
    assert [x["kind"] for x in r] == ["reparameterised"] and r[0]["windows"] == r[0]["item_windows"]


#: Questions with {names}, {numbers as digits} and {number words}, and two sets of values each.
QUESTIONS = [
    ("{0} picked up {a} dozen shells on the beach. {1} found twice as many shells as {0} and put them in a pocket. {2} grabbed half of the shells that {1} found. How many shells did {2} have?", ["Mimi", "Kyle", "Leigh"], ["Anna", "Peter", "Ruth"]),
    ("{0} earns {w} dollars an hour for babysitting. Yesterday, {0} did {v} minutes of babysitting. How much did {0} earn on that day?", ["Weng"], ["Clara"]),
    ("{0} is saving money for a new wallet which costs {a} dollars. {0} has only half of the money that is needed. How much more money does {0} need to buy the wallet?", ["Betty"], ["Igor"]),
    ("Each day {0} feeds every chicken {w} cups of mixed seed. In the morning {0} gives the flock {a} cups of feed. If the flock has {b} chickens, how many cups does {0} need in the last meal?", ["Wendi"], ["Maurice"]),
    ("{0} went to the store to buy glasses for a new flat. One glass costs {a} dollars, but every second glass costs only {b} percent of the price. How much does {0} have to pay for all of them?", ["Kylar"], ["Ottilie"]),
    ("The train from {0} to {1} takes {a} hours and stops {w} times on the way. If it leaves {0} at {b} o'clock, at what time of the day does it come to {1}?", ["New York", "Boston"], ["San Diego", "Tucson"]),
    ("{0} and {1} read the same book of {a} pages. While {0} reads {b} pages a day, {1} reads {c} pages a day and begins two days later. Who of them is the first to finish the book?", ["Rosa", "Emil"], ["Noor", "Bela"]),
    ("A farmer named {0} has {a} cows and {b} sheep in the field behind the house. {0} sells {w} of the cows and buys {v} more sheep. How many animals are in the field then?", ["Olaf"], ["Greta"]),
    ("In a garden there are {a} rows of trees with {b} trees each. If {w} trees are cut down in every row, how many trees does {0} still have in the garden?", ["Tom"], ["Sue"]),
    ("{0} walks {a} km to school in the morning and {b} km back by another way. How many km does {0} walk in a week of {w} school days and {v} days without school?", ["Mary Ann"], ["Billie Joe"]),
]
VALUES = [{"a": "2", "b": "15", "c": "40", "w": "twelve", "v": "fifty"}, {"a": "7", "b": "33", "c": "61", "w": "twenty-five", "v": "thirty"}]


def test_recall_of_reparameterised_questions(spark):
    """Ten questions with all names, numbers and number words changed: 0.9 of them at least are found, among 40 texts of the same common words."""
    items = [(i, q.format(*old, **VALUES[0])) for i, (q, old, _) in enumerate(QUESTIONS)]
    asked = [(i, q.format(*new, **VALUES[1])) for i, (q, _, new) in enumerate(QUESTIONS)]
    rng = random.Random(12)
    parts = [p for _, t in items for p in t.split(". ")]
    clean = [(100 + i, " ".join(" ".join(rng.choice(parts).split()[k : k + 6]) for k in rng.choices(range(0, 6), k=6))) for i in range(40)]
    clean += [(200, "How much does it cost to buy all of them? Who of them is the first to come home? At what time of the day does it start?")]
    d = spark.createDataFrame(asked + clean, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(d, i) for d, i, _ in got} <= {(i, i) for i, _ in items} and {k for _, _, k in got} == {"reparameterised"}
    assert len(got) >= 0.9 * len(items), sorted({i for i, _ in items} - {i for i, _, _ in got})


def test_wide_tokens(spark):
    x = spark.createDataFrame([("New York has twenty five shops. In New York they see Tom. Tom sees Twelve men.",)], "t string").select(decontaminate.wide_tokens(F.col("t"))).collect()[0][0]
    m, j = decontaminate.MARK, decontaminate.JOIN
    assert x == ["new", f"{m}york", "has", f"0twenty{j}five", "shops", "in", f"{m}new{j}{m}york", "they", "see", f"{m}tom", f"{m}tom", "sees", f"{m}twelve", "men"]


@pytest.mark.parametrize(
    "item, other",
    [
        ("What is the capital of France?", "What is the capital of Spain?"),
        ("12 + 7 * 3 - 4 / 2 + 9 * 5 - 1 = ?", "12 + 7 * 3 - 4 / 2 + 9 * 5 + 1 = ?"),
        ("法国的首都是什么城市", "法国的首都是什么国家"),
        ("Why?", "Who?"),
    ],
)
def test_items_without_windows_match_as_wholes(spark, item, other):
    for text in (item, f"before it {item.upper()} and after"):
        assert [(r["item_id"], r["kind"]) for r in leak(spark, text, item)] == [(9, "verbatim")]
    assert [r["kind"] for r in leak(spark, f"之前{item}之后", item)] == ["verbatim"]
    assert leak(spark, other, item) == []


def test_whole_items_of_many_lengths(spark):
    rng = random.Random(7)
    items = [(k, " ".join(rng.choices("12345", k=k))) for k in range(1, 40)] + [(None, "2 3 5"), (None, "7 7")]
    texts = [(k, " ".join(rng.choices("12345", k=120)) + " | " + " ".join(i for _, i in rng.sample(items, 3))) for k in range(12)] + [(3, "7 7"), (None, None)]
    got = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(d, i) for d, t in texts for i, x in items if f" {x} " in f" {t} "}
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted(want, key=str)


# ---------------------------------------------------------------- 2
def test_prefix_counts_are_exact():
    import sentencepiece as spm

    path = known.path("piece_bpe_32k.model")
    m, sp = token_counts.model(path), spm.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    cases = ["", " ", "a ", "  a  b", "▁", "x\x00y", "don't stop.", "日本 🙂"] + ["".join(rng.choices("ab ▁\nthe ▁é日<>0x.", k=rng.randint(1, 30))) for _ in range(150)]
    for x in cases:
        want = [len(sp.encode(x[:k])) for k in range(len(x) + 1)]
        assert m.at_prefixes(x).tolist() == want
        assert m.count(x) == want[-1]
        for budget in (1, 4):
            assert m.within(x, budget) == max(k for k, c in enumerate(want) if c <= budget)


def test_several_budgets(docs, texts):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=known.path("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(docs.limit(40), budgets=(7, 50)).collect():
        for n, fit in zip((7, 50), r["fits"]):
            t = texts[r["doc_id"]]
            assert len(sp.encode(t[:fit])) <= n and (fit == len(t) or len(sp.encode(t[: fit + 1])) > n)


def test_token_counts_of_documents(docs, texts):
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=known.path("piece_bpe_32k.model"))
    for r in token_counts.count_tokens(docs).collect():
        t = texts[r["doc_id"]]
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


# ---------------------------------------------------------------- 3
def brute_links(texts):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    links, root = Counter(), {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    return links, {i: top(i) for i in ids}


def family(n):
    """n near copies of a text of 60 words, with two words exchanged in each."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    out = {}
    for k in range(n):
        w = list(base)
        w[rng.randrange(60)] = f"x{k}"
        if k % 2:
            w[rng.randrange(60)] = f"y{k}"
        out[1000 + k] = " ".join(w)
    return out


@pytest.mark.parametrize("block", [400_000, 300])
def test_links_and_groups_match_brute_force(spark, texts, block):
    every = texts | family(25)
    d = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    members, groups = jaccard_join.classes(d, block=block)
    got = {r["doc_id"]: (r["links"] or 0, r["group_id"] if r["group_id"] is not None else r["doc_id"]) for r in members.join(groups, "cls", "left").collect()}
    links, root = brute_links(every)
    assert got == {i: (links[i], root[i]) for i in every}


@pytest.mark.parametrize("block", [400_000, 300, 60])
def test_groups_are_the_same_without_counting(spark, texts, block):
    every = texts | family(25) | {2000 + i: t.replace("w5 ", f"{t.split()[5]}z ") for i, t in enumerate(family(12).values())}
    d = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    members, groups = jaccard_join.classes(d, block=block, count=False)
    got = {r["doc_id"]: r["group_id"] if r["group_id"] is not None else r["doc_id"] for r in members.join(groups, "cls", "left").collect()}
    assert got == brute_links(every)[1]


def test_blocks_of_different_groups_meet(spark):
    """A bucket of several groups: only tasks across groups are left, and all pairs of different groups are in one."""
    cls = lambda i: bytes([i])
    kept = spark.createDataFrame([(cls(i), 10, 1, 4) for i in range(20)] + [(cls(i), 10, 2, 2) for i in range(9)], "cls binary, n long, h long, blocks int")
    roots = spark.createDataFrame([(cls(i), cls(0)) for i in range(16)] + [(cls(17), cls(16))], "node binary, root binary")
    tasks = jaccard_join.open_tasks(kept, roots, 50).collect()
    assert {r["bucket"] for r in tasks} == {1}  # the other bucket is one group
    root = {i: 0 if i < 16 else 16 if i < 18 else i for i in range(20)}
    meet = {}
    for r in tasks:
        meet.setdefault((r["a"], r["b"]), set()).add((r["cls"][0], r["own"]))
    pairs = {(min(x, y), max(x, y)) for (a, b), rows in meet.items() for x, o in rows for y, q in rows if x != y and (a == b or o != q)}
    assert all((i, j) in pairs for i in range(20) for j in range(i + 1, 20) if root[i] != root[j])
    assert not any(root[i] == root[j] == 0 for i, j in pairs)


def test_work_in_a_group_of_near_copies_is_linear():
    rng, base = random.Random(3), [f"w{i}" for i in range(150)]
    spots = [rng.randrange(150) for _ in range(3000)]
    found = [jaccard_join.shingles(" ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(spots)]
    calls = []

    class Counted(jaccard_join.Overlaps):
        def of(self, some):
            calls.append(len(some) * self.n)
            return super().of(some)

    old, jaccard_join.Overlaps = jaccard_join.Overlaps, Counted
    try:
        links, root = jaccard_join.verify(found, [np.zeros(0, np.int64)] * 3000, np.zeros(3000, np.int64), 0, 0.8, np.ones(3000), count=False)
    finally:
        jaccard_join.Overlaps = old
    assert (root == 0).all() and (links > 0).all() and sum(calls) <= 2 * jaccard_join.RUN


def test_measured_recall(spark):
    """Pairs of 0.8 to 0.85 similarity, which banding finds least often: 0.9 of them at least are found."""
    rng = random.Random(11)
    rows, n = [], 0
    while n < 300:
        w = [f"r{n}x{i}" for i in range(104)]
        v = list(w)
        for k in range(2):
            v[rng.randrange(10 + 50 * k, 50 + 50 * k)] = f"n{n}y{k}"
        a, b = jaccard_join.shingles(" ".join(w)), jaccard_join.shingles(" ".join(v))
        if 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.85:
            rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(v))]
            n += 1
    got = jaccard_join.links(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_links = 1 AND class_id % 2 = 0").count()
    assert got >= 0.9 * 600


def test_one_document_of_each_group_stays(spark, texts):
    every = texts | family(10)
    rows = [*every.items(), *list(every.items())[:5]]  # some rows repeat
    d = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = brute_links(every)
    assert sorted(r["doc_id"] for r in jaccard_join.deduplicate(d).collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("few", [0, 200_000])
def test_rows_go_by_either_join(spark, few, monkeypatch):
    monkeypatch.setattr(scratch, "FEW_KEYS", few)
    d = spark.createDataFrame([(i % 7, f"t{i}") for i in range(50)] + [(None, "n")], "k long, t string")
    gone = spark.createDataFrame([(1,), (3,), (9,)], "k long")
    got = sorted((r["k"], r["t"]) for r in scratch.without(d, gone, "k").filter("k IS NOT NULL").collect())
    assert got == sorted((i % 7, f"t{i}") for i in range(50) if i % 7 not in (1, 3)) and scratch.without(d, gone, "k").filter("k IS NULL").count() == 1


def test_ids_that_repeat_with_other_texts(spark):
    a, b = "a b c d e f g h", "completely other words stand in this one here"
    d = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.deduplicate(d).collect()) == [(1, a), (2, b)]


@pytest.mark.parametrize("name", [2, None])
def test_groups_of_one_name_stay_apart(spark, name):
    a, b = "a b c d e f g h", "completely other words stand in this one here"
    d = spark.createDataFrame([(name, a), (name, b), (name, a)], "doc_id long, text string")
    assert sorted(r["text"] for r in jaccard_join.deduplicate(d).collect()) == [a, b]


def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.997)
    assert bands * rows <= jaccard_join.HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.997


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "u binary, v binary")
    assert {bytes(r["root"]) for r in jaccard_join.components(e).collect()} == {bytes([0])}


# ---------------------------------------------------------------- 4
def test_estimation_finds_the_labellers_accuracy():
    rng = random.Random(1)
    right = [0.95, 0.9, 0.9, 0.85, 0.8, 0.9, 0.7]
    seen = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        seen["".join("-" if rng.random() < 0.1 else str(int(good == (rng.random() < p))) for p in right)] += 1
    _, hits = weak_label.estimate(seen)
    for p, (bad, good) in zip(right, hits.values()):
        assert abs(bad - p) < 0.03 and abs(good - p) < 0.03


def brute_scores(texts):
    """All steps anew, in plain loops: votes, expectation-maximisation over documents, logistic regression on dictionaries."""
    from quarry.llm.weak_label import BINS, LABELLERS

    pats = [weak_label.votes(t) for t in texts]
    p = [(v.count("1") + 1) / (v.count("1") + v.count("0") + 2) for v in pats]
    for _ in range(100):
        prior = [(sum(1 - x for x in p) + 1) / (len(p) + 2), (sum(p) + 1) / (len(p) + 2)]
        start = {("0", 0): 8, ("1", 0): 2, ("-", 0): 1, ("0", 1): 2, ("1", 1): 8, ("-", 1): 1}
        table = []
        for k in range(len(LABELLERS)):
            mass = {(c, good): start[c, good] + sum(x if good else 1 - x for v, x in zip(pats, p) if v[k] == c) for c in "01-" for good in (0, 1)}
            table.append({(c, good): m / sum(mass[d, good] for d in "01-") for (c, good), m in mass.items()})
        logs = [[math.log(prior[g]) + sum(math.log(table[k][c, g]) for k, c in enumerate(v)) for g in (0, 1)] for v in pats]
        p = [1 / (1 + math.exp(max(-50, min(50, a - b)))) for a, b in logs]
    feats = [Counter(weak_label.bins_of(t).tolist()) for t in texts]
    rows = [({b: c / sum(f.values()) ** 0.5 for b, c in f.items()}, y) for f, y in zip(feats, p) if f]
    n_good = sum(y >= 0.5 for _, y in rows)
    share = [0.5 / max(1, n_good) if y >= 0.5 else 0.5 / max(1, len(rows) - n_good) for _, y in rows]
    w, total, bias, total_bias = [0.0] * BINS, [1e-8] * BINS, 0.0, 1e-8
    used = sorted({b for f, _ in rows for b in f})
    for _ in range(200):
        off = []
        for (f, y), s in zip(rows, share):
            z = sum(c * w[b] for b, c in f.items()) + bias
            off.append(s * (1 / (1 + math.exp(-max(-50, min(50, z)))) - y))
        g = dict.fromkeys(used, 0.0)
        for (f, _), o in zip(rows, off):
            for b, c in f.items():
                g[b] += c * o
        for b in used:
            step = g[b] + 1e-4 * w[b] / BINS
            total[b] += step * step
            w[b] -= 0.5 * step / math.sqrt(total[b])
        total_bias += sum(off) ** 2
        bias -= 0.5 * sum(off) / math.sqrt(total_bias)
    return [1 / (1 + math.exp(-(sum(c * w[b] for b, c in f.items()) / sum(f.values()) ** 0.5 + bias))) if f else 0.0 for f in feats]


def test_scores_match_brute_force(docs):
    some = docs.filter(F.length("text") < 600).orderBy("doc_id").limit(60)
    rows = some.collect()
    want = dict(zip((r["doc_id"] for r in rows), brute_scores([r["text"] for r in rows])))
    for r in weak_label.score_table(some).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-5 and r["kept"] == (want[r["doc_id"]] >= weak_label.THRESHOLD)


def test_sample_is_bounded_and_never_empty(spark):
    rows = [(None, "the same words in every row of this table")] * 300 + [(None, f"text {i} of the table has a few words") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (None, 10**11):  # as if the table had so many rows
        patterns, got = weak_label.votes_and_sample(d, sample=50, rows=n)
        assert sum(patterns.values()) == 500 and 6 <= len(got) <= 50
    assert len(weak_label.votes_and_sample(d, sample=400)[1]) == 201  # repeated rows count once
    assert weak_label.votes_and_sample(d.limit(0), sample=50) == ({}, [])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    s = weak_label.score_table(scratch.read(spark, sf, "documents")).join(scratch.read(spark, sf, "labels"), "doc_id").collect()
    good = [r["kept"] for r in s if r["quality"] == 1]
    bad = [r["kept"] for r in s if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1


# ---------------------------------------------------------------- 5
def test_common_prefix_is_rendered_once(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "hello"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "go"), (1, "rejected", 1, "assistant", "go"), (2, "chosen", 0, "user", None)]
    got = {r["pair_id"]: r for r in preference.format_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string")).collect()}
    r = got[1]
    assert (r["status"], r["prompt_turns"], r["prompt"]) == ("pair", 1, "<|user|>\nhi<|end|>\n")
    start, end = map(int, r["chosen_spans"].split("-"))
    assert r["chosen"][start:end] == "hello<|end|>\n" and r["rejected"] == "<|assistant|>\ngo<|end|>\n"
    assert got[2]["status"] == "single" and got[2]["rejected"] == ""


TURNS = "conv_id long, turn long, role string, text string"


def threads():
    """Conversations that share beginnings of several lengths, equal ones, lone ones, nulls, repeated rows and ties."""
    rng = random.Random(8)
    rows = []
    for c in range(60):
        shared = [f"t{c % 3}", f"u{c % 6}", f"v{c % 12}"][: c % 4]
        said = shared + [f"own {c} {k}" for k in range(rng.randint(1, 3))]
        if c % 10 == 9:
            said = ["hello", "same to the end"]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(said)]
    odd = [(70, None, None, None), (70, 1, None, "x"), (None, 0, "user", "lost"), (71, 0, "user", "tie a"), (71, 0, "user", "tie b"), (72, 0, "", "")]
    return rows + odd + rows[:7]


def test_pairs_share_what_they_can(spark, tmp_path):
    import duckdb

    d = spark.createDataFrame(threads(), TURNS)
    got = [r.asDict() for r in preference.format_pairs(preference.neighbours(d)).collect()]
    d.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    want = con.execute(preference.ORACLE).fetchdf().to_dict("records")
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r["prompt_turns"] >= 1 for r in got) >= 20 and sum(r["prompt_turns"] >= 2 for r in got) >= 8
    assert sum(r["status"] == "same" for r in got) == 3 and sum(r["status"] == "single" for r in got) <= 1
    starts = Counter(r["prompt"].split("<|end|>")[0] for r in got if r["prompt_turns"])
    first = Counter(x for (_, turn, _, x) in set(threads()) if turn == 0 and x.startswith("t"))
    assert all(starts[f"<|user|>\n{x}"] == n // 2 for x, n in first.items() if " " not in x)


def test_odd_conversations(spark):
    d = spark.createDataFrame(threads(), TURNS)
    extra = d
    for c in ("pair_id", "side", "key", "first", "place", "p", "n", "x", "other"):
        extra = extra.withColumn(c, F.lit("mine"))
    key = lambda df: sorted(map(str, preference.format_pairs(preference.neighbours(df)).collect()))
    assert key(extra) == key(d) and len(key(d)) == 32
    assert key(d.limit(0)) == [] and key(d.filter("conv_id IS NULL")) == []


# ---------------------------------------------------------------- 6
def brute_measures(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_measures_match_brute_force(docs, texts):
    for r in divergence.rule_table(docs).collect():
        want = brute_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_divergence_separates_junk(spark):
    sf = "/root/testdata/sf0.01"
    rows = divergence.rule_table(scratch.read(spark, sf, "documents")).join(scratch.read(spark, sf, "labels"), "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.3


def test_references_do_not_depend_on_partitions(docs):
    a, b = (sorted(map(str, divergence.references(docs.repartition(n)).collect())) for n in (1, 7))
    assert a == b


# ---------------------------------------------------------------- 7
def test_lookup_table_is_even_and_stable():
    names = maglev.shard_names(10)
    table = maglev.lookup_table(names, 1009)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = maglev.lookup_table(names[:-1], 1009)
    moved = sum(names[a] != names[b] for a, b in zip(table, fewer) if a != 9)
    assert moved / 1009 < 0.2
    with pytest.raises(ValueError):
        maglev.lookup_table(names, 1000)


# ---------------------------------------------------------------- 8
@pytest.mark.parametrize("chunk, overlap", [(32_768, 1_024), (200, 40), (7, 2)])
def test_chunks_stitch_to_the_whole(spark, chunk, overlap):
    bpe = byte_bpe.coder()
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(["the ", "cat's", "\n\n", "  ", "é", "日本", "1234", "!?", "aaaa" * 3], k=rng.randint(0, 120)))) for i in range(40)] + [(99, "z" * 500), (99, "z" * 500), (100, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"], r["n_tokens"]) for r in byte_bpe.round_trip(d, chunk=chunk, overlap=overlap).collect())
    want = []
    for i, t in rows:
        ids = bpe.core.encode_ordinary(t or "")
        want.append((i, hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)))
    assert got == sorted(want)


def test_stitching_at_every_cut():
    bpe = byte_bpe.coder()
    rng = random.Random(9)
    some = ["we'll", "'re", "'ve", " ", "  ", "\n", "a", "12", "!?", "'", "é", "日本", "'l", " 'v", "zzzz"]
    cases = [("".join(rng.choices(some, k=rng.randint(1, 14))), c, o) for _ in range(1500) for c, o in ((1, 1), (2, 1), (3, 2), (5, 1), (7, 2), (4, 4))]
    cases += [(("the cat sat " * 4000)[: n - len(end)] + end, byte_bpe.CHUNK, byte_bpe.OVERLAP) for end in ("we'll", "'re", "'ve", "x'll y") for n in range(33_788, 33_798)]
    for text, chunk, overlap in cases:
        parts = list(byte_bpe.cut(text, chunk, overlap))
        assert bpe.stitch(text, [(at, at + len(p), bpe.boundaries(p)) for at, p in parts]) == bpe.pieces(text), (text[-40:], chunk, overlap)


def test_long_text_that_ends_in_a_contraction(spark):
    text = ("the cat sat " * 4000)[: 33_793 - 5] + "we'll"
    d = spark.createDataFrame([(1, text)] * 5 + [(None, text)], "doc_id long, text string")
    ids = byte_bpe.coder().core.encode_ordinary(text)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in byte_bpe.round_trip(d).collect()]
    assert sorted(got, key=str) == sorted([(i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()) for i in (1, 1, 1, 1, 1, None)], key=str)


def test_decode_gives_the_bytes(docs, texts):
    for r in byte_bpe.decode(byte_bpe.encode(docs)).collect():
        assert bytes(r["bytes"]) == texts[r["doc_id"]].encode()


# ---------------------------------------------------------------- 9
def main_text(page):
    return html_region.extract(page, html_region.weights({}))


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><h1>T &amp; U</h1><p>one\n two<br>three</p><p>four</article><footer>f</footer>", "T & U\n\none two three\n\nfour"),
        ("<nav><ul><li><a>Home</a></li></ul></nav><main><p>body text of the page</p><aside>no</aside><form>no</form></main>", "body text of the page"),
        ("<div class=menu>a b c d e f</div><div id=content><h2>Head</h2><p>Some longer text stands here.</p><ul><li>item one</li></ul></div><div class='comments'><p>nice</p></div>", "Head\n\nSome longer text stands here.\n\nitem one"),
        ("<article><header><h1>Title</h1><p>by x</p></header><p>Body.</p><section class=comments><article class=comment>bad</article></section></article>", "Title\n\nBody."),
        ("<script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes &lt;b&gt;</p>", "yes <b>"),
        ("<article><p>One two.</p><div class='ad-box'><ul>" + "<li>buy this now</li>" * 40 + "</ul></div><p>Three four.</p></article><p>Site words.</p>", "One two.\n\nThree four."),
        ("<article><p>cut off here &am", "cut off here &am"),
        ("", ""),
        (None, ""),
        ("<nav>only menus</nav>", ""),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p>One <svg viewBox='0 0 1 1'/> two.</p><p>Three.</p></article>", "One two.\n\nThree."),
        ("<article><p>One <math/> two.</p><p>Three <svg><text>no</text></svg> four.</p></article>", "One two.\n\nThree four."),
        ("<article><p>As <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p></article>", "As a=b holds."),
        ("<article><h2 id='social-impact'>Impact</h2><p>One two.</p><h2 id=comments>On comments</h2></article>", "Impact\n\nOne two.\n\nOn comments"),
        ("<article><section id='legal-status'><p>One two.</p></section><p class='notice-of-rights'>Three.</p></article>", "One two.\n\nThree."),
        ("<article><p>One two.</p><div class='share-buttons'>no</div><div class='wide ad'>no</div><p>Three.</p></article>", "One two.\n\nThree."),
    ],
)
def test_article_text_is_whole(page, want):
    assert main_text(page) == want


def test_scan_finds_the_best_region():
    rng = random.Random(4)
    for _ in range(30):
        words = [rng.choice(["<div>", "</div>", "word", "<a>link</a>", "<p>", "</p>"]) for _ in range(12)]
        items = html_region.parse(" ".join(words))
        w = html_region.weights({})
        s = html_region.scores(items, w)
        best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        total = run = 0.0
        for v in s:
            run = max(0.0, run) + v
            total = max(total, run)
        assert math.isclose(total, max(0.0, best), abs_tol=1e-9)


def test_pages_of_the_tables(spark, sf):
    import html as h
    import re

    pages = scratch.read(spark, sf, "pages")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_region.extract_pages(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", raw[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(h.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_pages_with_nulls(spark):
    d = spark.createDataFrame([(1, None, None), (None, "u", "<p>a b c</p>"), (1, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("mine"))
    assert sorted((r["n_chars"], r["text"]) for r in html_region.extract_pages(d).collect()) == [(0, ""), (0, ""), (5, "a b c")]


@pytest.mark.parametrize("piece", ['<a "', "<a ", "<div>", "<div class='x y'>", "<!-- ", "<table><div></tr><tr>", "<article><div></p>", "<li><div>", "< <", "</p", "<p class=a" + " b" * 9, '<p x="', "<script>", "a &amp ", "<ul><li>x", "<option><a>"])
def test_broken_pages_take_linear_time(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    took = []
    for part in (page[:250_000], page):
        began = time.process_time()
        html_region.extract(part, html_region.weights({}))
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05), took


def templated(k, article="article", body=""):
    """A page with words before and after its article, and a container whose name tells nothing."""
    words = " ".join(f"w{k}x{i}" for i in range(30))
    want = f"Head {k}\n\n{words}\n\nso ends page {k}{body and chr(10) * 2 + body}"
    page = f"<html><body><p>Site {k}.</p><div class='qz-{k % 3} zone'>" + f"<p>outside {words}</p>" * 2 + f"</div><{article}><h1>Head {k}</h1><p>{words}</p><div class='zone'>never {k}</div><p>so ends page {k}</p>"
    return page + (f"<p>{body}</p>" if body else "") + f"</{article}><p>Last {k}.</p></body></html>", want


def test_weights_and_scan_decide(spark):
    """Held-out pages; leaving out the taught weights, or the scan, changes what is found."""
    pages = [templated(k) for k in range(60)]
    seen = html_region.tally(p for p, _ in pages[:40])
    taught = html_region.weights(seen)
    plain = html_region.weights({k: v for k, v in seen.items() if k.startswith("<") or k == "text"})
    held = pages[40:]
    assert all(html_region.extract(p, taught) == want for p, want in held)
    assert not any(html_region.extract(p, plain) == want for p, want in held)
    for p, want in held:
        assert "Site" in "".join(x.text for x in html_region.parse(p, taught) if not x.low) and "Site" not in want


def test_extraction_without_landmarks(spark, sf):
    """Weights from pages that mark their article find it on held-out pages whose mark is taken away."""
    pages = [r["html"] for r in scratch.read(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    taught = html_region.weights(html_region.tally(pages[::2]))
    same = [html_region.extract(p.replace("<article>", "<div>").replace("</article>", "</div>"), taught) == html_region.extract(p, html_region.weights({})) for p in pages[1::2]]
    assert sum(same) >= 0.99 * len(same)


def test_learning_on_very_large_and_empty_tables(spark, sf):
    pages = scratch.read(spark, sf, "pages")
    assert html_region.learn(pages, rows=10**12)[".ad"] < -2  # some pages are found all the same
    assert html_region.learn(pages.limit(0)) == html_region.weights({})
    none = html_region.extract_pages(pages.limit(0))
    assert none.count() == 0 and none.columns == ["page_id", "url", "text", "n_chars"]


def test_pages_with_clashing_columns(spark, sf):
    pages = scratch.read(spark, sf, "pages")
    extra = pages
    for c in ("text", "n_chars", "kind", "within", "outside", "pages"):
        extra = extra.withColumn(c, F.lit("mine"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(html_region.extract_pages(extra)) == key(html_region.extract_pages(pages))


# ---------------------------------------------------------------- 10
def test_wavelet_matrix_against_lists():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_257, 3000).astype(np.uint16)
    a[::5] = 7
    ids, lengths, wm = wavelet.unpack(wavelet.pack([None, 3], [1000, 2000], wavelet.WaveletMatrix.build(a)))
    assert ids == [None, 3] and lengths.tolist() == [1000, 2000] and (wm.ids() == a).all()
    for i in (0, 511, 512, 2999):
        assert wm.access(i) == a[i]
    for s in (7, int(a[1]), 50_000):
        at = np.flatnonzero(a == s)
        assert wm.rank(s) == len(at) and wm.rank(s, 700) == int((a[:700] == s).sum())
        for k in range(0, len(at), 53):
            assert wm.select(s, k) == at[k]
        with pytest.raises(IndexError):
            wm.select(s, len(at))


def test_damaged_file_is_noticed():
    image = bytearray(wavelet.pack([1], [2], wavelet.WaveletMatrix.build(np.array([3, 4], np.uint16))))
    image[6] ^= 1
    with pytest.raises(ValueError):
        wavelet.unpack(bytes(image))


def test_ends_of_words():
    words = ["a,", "b", "c,,,,,,,,", "d,", "é!?", "f,,,,,,,,", "g,,,,,,,,,", "x\x00", "y"]
    after = np.array([1, 1, 1, 1, 2, 1, 1, 1, 1])
    ends, number = wavelet.tail_table(pa.array(["skipped", *words]).slice(1), after)
    assert [ends[k] for k in number.tolist()] == [",", "", ",,,,,,,,", ",", "!?", ",,,,,,,,", ",,,,,,,,,", "\x00", ""] and len(ends) == len(set(ends))
    assert wavelet.tail_table(pa.array([], pa.string()), np.zeros(0, np.int64))[0] == []


def test_words_encode_as_the_library_does():
    w = wavelet.coder(None)
    rng = random.Random(6)
    cases = ["", " ", "a<|endoftext|> b", "x <|endoftext|>  y", " a", "it's, well... \xa0 no", "end.\n next"] + ["".join(rng.choices("ab  \n\t'ts,. 1é日<|>\xa0", k=rng.randint(1, 25))) for _ in range(400)]
    for end in (None, 0):
        got, sizes = w.encode(pa.array(cases), end)
        at = 0
        for x, n in zip(cases, sizes.tolist()):
            assert got[at : at + n].tolist() == w.core.encode(x, add_special_tokens=False).ids + ([] if end is None else [end])
            at += n


def test_shards_read_back(spark, docs, texts):
    core = wavelet.coder(None).core
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.write_and_read(docs, shard_tokens=5_000).collect())
    at = 0
    for (start, i, n, crc), want in zip(got, sorted(texts)):
        ids = core.encode(texts[want], add_special_tokens=False).ids + [0]
        assert (start, i, n, crc) == (at, want, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += n
