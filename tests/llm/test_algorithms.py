"""Caps, splitting, near duplicates and survivors against brute force on small tables."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillweave.llm import caps, neardups, splitting, survivors


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "id string, contributors array<string>, score double, rank string, capacity string")


def greedy(rows, capacity):
    """Best first; a record stays if all its contributors have room."""
    best, listed = {}, {}
    for i, c, s in rows:
        s = -1.0 if s is None or s != s else s
        best[i] = max(best.get(i, -1.0), s)
        listed.setdefault(i, set()).update(x for x in c or [] if x is not None)
    room, out = dict(capacity), set()
    for i in sorted(best, key=lambda i: (-best[i], i)):
        if all(room.get(c, 1) > 0 for c in listed[i]):
            for c in listed[i] & room.keys():
                room[c] -= 1
        else:
            out.add(i)
    return out


def test_matching_of_several_contributors(spark):
    draw = random.Random(3)
    rows = [(f"r{i:03}", draw.sample("abcdef", draw.randint(1, 3)), draw.choice([None, float("nan"), 0.1, 0.5, 0.5, 0.9])) for i in range(120)]
    rows += [("r000", rows[0][1], rows[0][2]), ("none", None, 0.9), ("empty", [], 0.1), ("nulls", [None, None], 0.1), ("twice", ["a", "a"], 1.0)]
    limits = {"a": 10, "b": 5, "c": 0, "d": 1000, "e": 7}
    capacities = spark.createDataFrame(list(limits.items()), "contributor string, capacity bigint")
    out = caps.cap_contributors(records(spark, rows), capacities).collect()
    assert len(out) == len({r[0] for r in rows}) == len({r.id for r in out})
    assert {r.id for r in out if r.displaced_by is not None} == greedy(rows, limits)


def test_chains_take_few_rounds(spark, monkeypatch):
    """Each record shares a contributor of capacity 1 with the next: who stays is decided along the chain."""
    rows = [(f"{i:04}", [f"c{i}", f"c{i + 1}"], 1 - i / 1000) for i in range(300)] + [("x", ["c7", "c9", "c200"], 0.9965), ("y", None, 1.0), ("z", ["c1", "c1"], 5.0)]
    capacity = {f"c{i}": 2 if i == 150 else 1 for i in range(301)}
    rounds = []
    ranked = caps.rank_in_groups
    monkeypatch.setattr(caps, "rank_in_groups", lambda *a: rounds.append(1) or ranked(*a))
    df = spark.createDataFrame(rows, "id string, contributors array<string>, score double")
    limits = spark.createDataFrame(list(capacity.items()), "contributor string, capacity bigint")
    out = caps.cap_contributors(df, limits).collect()
    assert {r.id for r in out if r.displaced_by} == greedy(rows, capacity)
    assert len(rounds) <= 6


def test_hot_contributor_and_ties(spark):
    rows = [(f"r{i:04}", ["hot"], 0.5) for i in range(900)] + [(f"s{i}", ["cold"], 0.1) for i in range(3)]
    capacities = spark.createDataFrame([("hot", 17), ("cold", 3)], "contributor string, capacity bigint")
    out = caps.cap_contributors(records(spark, rows), capacities)
    kept = {r.id for r in out.where("displaced_by is null").collect()}
    assert kept == {f"r{i:04}" for i in range(17)} | {"s0", "s1", "s2"}
    assert caps.cap_contributors(records(spark, []), capacities).count() == 0


def test_rank_in_groups(spark):
    df = spark.createDataFrame([("a", i % 7, i) for i in range(300)] + [("b", 1, 1)], "g string, s int, i int")
    got = {(r.g, r.i): r["rank"] for r in caps.rank_in_groups(df, "g", [F.col("s").desc(), F.col("i")], slices=5).collect()}
    want = {("a", i): n for n, (_, i) in enumerate(sorted((-(i % 7), i) for i in range(300)), 1)} | {("b", 1): 1}
    assert got == want


def test_repository_spellings(spark):
    names = [" Repo.git", "repo-main", "REPO-master.git", "repo.git-main", "repo", None, "repo-maintenance"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(caps.repo_key(F.col("n")).alias("k"))
    assert [r.k for r in df.collect()] == ["repo", "repo", "repo", "repo.git", "repo", None, "repo-maintenance"]


def test_latest_score(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [("a", 1, day, 0.1), ("a", 2, day, 2.0), ("b", 1, day, -1.0), ("c", 1, None, None), ("d", 1, day, float("nan")), ("d", 1, day, float("nan"))]
    tags = spark.createDataFrame(rows, "data_id string, tag_id bigint, tagged_at timestamp, reusable_intent_score double")
    assert {r.data_id: r.score for r in caps.latest_score(tags).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}


PYTHON = "# head\nimport os\n\n\n# about f\n@deco(\n    1,\n)\ndef f(x):\n    def inner():\n        pass\n    return '''\ndef no():\n'''\n\n@last\n\nclass A:\n    def m(self):\n        pass\n\nif __name__ == '__main__':\n    def late():\n        pass\nasync def g():\n    pass\n"


def lines(text: str, language: str) -> list[int]:
    from skillweave.llm.syntax.outline import declaration_lines

    return declaration_lines(text, language)


def test_declarations():
    assert lines(PYTHON, "python") == [5, 18, 25]
    assert lines("    def m(self):\n        pass\n", "python") == [1]
    js = "import { a } from 'b';\n// c\nexport async function f(a) {\n  function g() {}\n}\nconst h = function () {};\nconst t = `\nfunction no() {}\n`;\n\n/* d\n * e */\nexport default class A {}\nlet x = 1\nfunction z() {}\n!function () { function q() {} }();\n"
    assert lines(js, "javascript") == [2, 11, 15]
    ts = "@Injectable()\nexport abstract class A {}\nexport interface B { f(): void }\ntype C<T> = T | null;\nconst d: C<number> = null;\ndeclare enum E { X }\n"
    assert lines(ts, "typescript") == [1, 3, 4, 6]
    go = "package a\n\nimport \"x\"\n\n// doc\ntype T struct {\n\tA int\n}\nvar f = func() {}\nconst s = `\nfunc no() {\n`\nfunc (t *T) M() {\n}\nfunc g() {}\n"
    assert lines(go, "go") == [5, 13, 15]
    java = "package a;\nimport b.C;\n/** doc\n */\n@Note(x = 1)\npublic final class A {\n  void m() {}\n}\n\ninterface B {}\n"
    assert lines(java, "java") == [3, 10]
    rust = "use a::b;\n#[derive(Debug)]\npub struct A { x: u8 }\npub(crate) fn f() {}\nconst X: u8 = 1;\nenum E { A }\n"
    assert lines(rust, "rust") == [2, 4, 6]
    c = "#include <a.h>\n#define X(a) {\nstruct s {\n  int a;\n};\nstatic const struct s t[] = { {1} };\nstatic int f(struct s *p) {\n  goto end;\nend:\n  return 0;\n}\ntypedef int number;\n"
    assert lines(c, "c") == [3, 7, 12]
    cpp = "template <class T>\nT f(T a) { return a; }\nclass A : public B {\n public:\n  void g() {}\n};\nnamespace n { void h() {} }\nauto x = [](int a) { return a; };\nA::A() : b(1) {}\n"
    assert lines(cpp, "cpp") == [1, 3, 9]
    # texts that don't parse still have an outline
    assert lines("def f():\n    x = (\n\n\ndef g():\n", "python")[:1] == [1]
    assert lines("function f() {\n<<<<<<< a\n}\n=======\n}\n", "javascript") == [1]
    assert lines("", "python") == [] and lines("a: 1", "yaml") == []


def test_pieces_cover_and_overlap(spark):
    draw = random.Random(5)
    body = "".join(f"def f{i}(é):\n" + "".join(f"    x{j} = {'y' * draw.randint(1, 60)}\n" for j in range(draw.randint(1, 9))) + "\n" for i in range(60))
    texts = {"a": body, "long": "x = '" + "é" * 5000 + "'", "small": "x", "blank": "\n" * 3000, "none": None, "empty": "", "edge": "x" * 1000, "over": "x" * 1001, "json": '{"a": "' + "b" * 3000 + '"}'}
    rows = [(k, "p.json" if k == "json" else "p.py", t, 1) for k, t in texts.items()] + [("a", "p.py", body, 2)]
    df = spark.createDataFrame(rows, "data_id string, path string, code string, offset int")
    pieces = {}
    for p in splitting.split_items(df, "data_id", "path", "code", limit=1000, overlap=100).collect():
        pieces.setdefault(p.id, []).append(p)
    assert set(pieces) == {"a", "long", "blank", "over", "json"}
    for key, own in pieces.items():
        own.sort(key=lambda p: p.piece)
        text = texts[key]
        assert own[0].first == 0 and own[-1].last == len(text) and [p.piece for p in own] == list(range(1, len(own) + 1))
        for p, q in zip(own, own[1:]):
            shared = text[q.first : p.last].encode()
            assert p.first < q.first and 100 <= len(shared) <= 500
        assert all(p.text == text[p.first : p.last] and len(p.text.encode()) < 1000 + (len(own) == 1) for p in own)
    starts = [p for p in pieces["a"][1:] if p.text.startswith("def ")]
    assert len(starts) >= 0.8 * (len(pieces["a"]) - 1)
    empty = df.where("false")
    assert splitting.split_items(empty, "data_id", "path", "code").count() == 0


def test_declarations_are_read_off_the_pieces(spark):
    body = "".join(f"def f{i}(x):\n    return x + {i}\n\n\n" for i in range(120))
    df = spark.createDataFrame([("a", "p.py", body), ("b", "p.py", body[:300])], "data_id string, path string, code string")
    bounds = splitting.boundary_table(df, "data_id", "path", "code", 1000, 100).cache()
    pieces = splitting.piece_table(bounds)
    found = splitting.declarations_in_pieces(bounds, pieces).collect()
    assert {(r.id, r.line) for r in found} == {("a", 4 * i + 1) for i in range(120)}
    # what begins in an overlap begins in two pieces
    assert len(found) > 120 and {r.piece for r in found} == {r.piece for r in pieces.collect()}


def test_successors_of_a_long_line():
    import numpy as np

    offsets, kinds = np.array([0, 40, 80, 120, 160, 200]), np.array([2, 0, 0, 0, 0, 2])
    end, then = splitting.successors(offsets, kinds, 100, 20)
    assert end.tolist() == [80, 120, 160, 200, 200, 200] and then.tolist() == [40, 80, 120, -1, -1, -1]


def brute_pairs(texts: dict[str, str], size: int, threshold: float, least: int) -> set[tuple[str, str]]:
    import re

    sets = {}
    for k, t in texts.items():
        words = [w.lower() for w in re.findall("[A-Za-z0-9_]+", t or "")]
        if len(words) >= least:
            sets[k] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_near_duplicates(spark):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts: dict[str, str] = {}
    for i in range(40):
        base = draw.choices(words, k=80)
        for j in range(4):
            own = [w if draw.random() > 0.02 * j else draw.choice(words) for w in base]
            texts[f"{i:02}-{j}"] = " ".join(own)
    texts |= {f"copy{i:03}": "The same text. " * 20 for i in range(60)}
    texts |= {"case": "THE SAME, text! " * 20, "short": "a b c", "blank": " ", "empty": "", "long": " ".join(draw.choices(words, k=30_000))}
    rows = [(k, t, "x") for k, t in texts.items()] + [("null", None, "x"), ("00-0", texts["00-0"], "y")]
    df = spark.createDataFrame(rows, "data_id string, code string, class string")
    members, links = neardups.near_duplicates(df, "data_id", "code", shingle=3, threshold=0.6, min_words=30)
    got = {tuple(r) for r in neardups.record_pairs(members, links).collect()}
    assert got == brute_pairs(texts, 3, 0.6, 30)
    none = neardups.near_duplicates(df.where("false"), "data_id", "code")
    assert none[0].count() == none[1].count() == 0


@pytest.mark.parametrize("crowd, size", [(3, 4), (10, 7), (1000, 1000)])
def test_pairs_of_buckets(crowd, size):
    draw = random.Random(crowd)
    rows = sorted((draw.randrange(12) ** 2, draw.randrange(10**9)) for _ in range(150))
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size])], names=["bucket", "class"]) for i in range(0, 150, size)]
    out = [r for b in neardups._paired(iter(batches), crowd) for r in b.to_pylist()]
    groups: dict[int, list[int]] = {}
    for k, c in rows:
        groups.setdefault(k, []).append(c)
    small = {k: v for k, v in groups.items() if len(v) <= crowd}
    want = sorted((min(x, y), max(x, y)) for v in small.values() for i, x in enumerate(v) for y in v[i + 1 :])
    assert sorted((r["a"], r["b"]) for r in out if not r["crowded"]) == want
    assert sorted((r["a"], r["b"]) for r in out if r["crowded"]) == sorted((k, c) for k, v in groups.items() if k not in small for c in v)


def test_crowded_buckets_are_paired_in_blocks(spark):
    rows = [(b, 10 * b + i) for b in (1, 2) for i in range(9)] + [(3, 11), (3, 12)]
    df = spark.createDataFrame(rows, "bucket bigint, class bigint")
    want = {(10 * b + i, 10 * b + j) for b in (1, 2) for i in range(9) for j in range(i + 1, 9)}
    assert sorted(tuple(r) for r in neardups.proposed(df, 4).collect()) == sorted(want)


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8])
def test_recall(spark, threshold):
    """Pairs just above the threshold are found, whatever it is."""
    draw = random.Random(11)
    rows = []
    n = 120
    for i in range(150):
        # n shared words in a row of others on both sides: sets of words, so that the similarity is set exactly
        shared = [f"s{i}x{j}" for j in range(n)]
        own = round(n * (1 / (threshold + 0.005) - 1) / 2)
        for side in "ab":
            rest = [f"{side}{i}x{j}" for j in range(own)]
            words = shared + rest
            draw.shuffle(words)
            rows.append((f"{i}{side}", " ".join(words)))
    df = spark.createDataFrame(rows, "data_id string, code string")
    members, links = neardups.near_duplicates(df, "data_id", "code", shingle=1, threshold=threshold)
    pairs = {tuple(r) for r in neardups.record_pairs(members, links).collect()}
    assert len(pairs & {(f"{i}a", f"{i}b") for i in range(150)}) >= 0.99 * 150
    rows, bands = neardups.banding(threshold)
    assert 1 - (1 - threshold**rows) ** bands >= neardups.RECALL


def test_pruning_bound():
    for n in (16, 64, 128):
        m = neardups.least_matches(0.6, 1e-5, n)
        assert 0 < m < 0.6 * n
    assert neardups.least_matches(0.6, 1e-5, 128) > neardups.least_matches(0.6, 1e-5, 16)


def test_survivors(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [
        ("g", 3, day, "A", 1), ("g", 1, day, "a ", 1), ("g", 2, None, "b", 3), ("g", 2, None, "b", 3), ("g", 4, day, " ", 9), ("g", 5, day, None, 9),
        ("h", 6, day, "x", 1), ("h", 7, day, "y", 1), ("i", 8, None, None, 1), (None, 9, day, "z", 1),
    ]
    df = spark.createDataFrame(rows, "grp string, record_id bigint, at timestamp, v string, w int")
    fields = {"v": survivors.FieldVote(F.col("v"), F.col("w"), F.lower(F.trim("v")))}
    out = {r.group: r for r in survivors.survivors(df, F.col("grp"), F.col("record_id"), F.col("at"), fields).collect()}
    assert set(out) == {"g", "h", "i"}
    # b has 3 votes from one record however often it is repeated, a has 2 from two
    assert out["g"].v == "b" and (out["g"].min_id, out["g"].max_id) == (1, 5)
    assert out["h"].v == "x" and out["i"].v is None
    trusted = survivors.survivors(df, F.col("grp"), F.col("record_id"), F.col("at"), fields, trust=F.when(F.col("record_id") == 2, 0.5).otherwise(1.0))
    assert {r.group: r.v for r in trusted.collect()}["g"] in ("A", "a ")
    assert survivors.survivors(df.where("false"), F.col("grp"), F.col("record_id"), F.col("at"), fields).count() == 0


def test_votes_of_parts_add_up(spark):
    rows = [(1, "a", 1, 1, 0), (1, "b", 2, 0, 1), (1, "b", 3, 0, 1), (1, "b", 3, 0, 1), (1, "a", 4, 1, 1)]
    df = spark.createDataFrame(rows, "g int, v string, id bigint, x int, y int")
    votes = [survivors.FieldVote(F.col("v"), F.col("x")), survivors.FieldVote(F.col("v"), F.col("y"), decay=F.lit(0.25))]
    at = F.lit(None).cast("timestamp")
    assert survivors.survivors(df, F.col("g"), F.col("id"), at, {"v": votes}).first()["v"] == "a"
    votes[1] = survivors.FieldVote(F.col("v"), F.col("y"), trust=F.lit(3.0))
    assert survivors.survivors(df, F.col("g"), F.col("id"), at, {"v": votes}).first()["v"] == "b"


def test_recency_halves(spark):
    now = dt.datetime(2026, 3, 1)
    df = spark.createDataFrame([(now,), (dt.datetime(2026, 1, 30),), (None,)], "at timestamp")
    got = [r[0] for r in df.select(survivors.recency(F.col("at"), F.lit(now), 30.0)).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 1e-9 and abs(got[2] - 0.5**10) < 1e-12
