from __future__ import annotations

import random

from lorespark.llm.leaks import align, leaks
from lorespark.llm import repeats
from lorespark.llm.repeats import by_letters, clusters, masked_form, repeated_lines, similar_pairs, without_lines

ITEM = "the quick brown fox jumps over the lazy dog near the river bank while seven owls watch from an old oak"
W = ITEM.split()


def test_leaks(spark):
    items = spark.createDataFrame([(1, ITEM, 0), (2, "only five words are here", 0), (3, None, 0), (4, " ", 0), (5, "two words", 0)], "item_id BIGINT, text STRING, doc_id INT")
    docs = [
        (10, "intro text " + ITEM.upper().replace(" ", " - ") + " outro"),
        (11, "x " + " ".join(W[3:16]) + " y"),  # thirteen words
        (12, "x " + " ".join(W[3:15]) + " y"),  # twelve
        (13, "say ONLY five, words are here!"),
        (14, "only five words were here"),
        (15, " ".join(W[:8] + ["new"] + W[8:])),  # edited: eight and thirteen
        (16, None), (17, ""), (18, "z " * 5000 + ITEM), (19, "here are two words, and more of them"), (10, "intro text " + ITEM),
    ]
    got = {(r.doc_id, r.item_id): r for r in leaks(spark.createDataFrame([(*d, 1) for d in docs], "doc_id BIGINT, text STRING, score INT"), items).collect()}
    found = {k for k, r in got.items() if r.longest_run >= r.needed}
    assert found == {(10, 1), (11, 1), (13, 2), (15, 1), (18, 1), (19, 5)}
    assert {k for k, r in got.items() if r.leaked} == found and (12, 1) not in found
    assert got[(10, 1)].score == 1.0 and got[(15, 1)].score > 0.9 and got[(18, 1)].last_word == 5000 + len(W)
    assert leaks(spark.createDataFrame([], "doc_id BIGINT, text STRING"), items).isEmpty()
    assert leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), items.limit(0)).isEmpty()


def test_edited_copies(spark):
    """One word in five changed, put in or dropped; texts of the same words in another order leak nothing."""
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghijklmno", k=6)) for _ in range(400)]
    items = [[r.choice(vocabulary) for _ in range(r.randrange(25, 120))] for _ in range(60)]
    docs, want = [], set()
    for n, item in enumerate(items):
        for way in range(3):
            out = []
            for w in item:
                hit = r.random() < 0.2
                out += ([r.choice(vocabulary)] if way == 0 else [w, r.choice(vocabulary)] if way == 1 else []) if hit else [w]
            docs.append((n * 10 + way, " ".join([r.choice(vocabulary) for _ in range(200)] + out + [r.choice(vocabulary) for _ in range(100)])))
            want.add((n * 10 + way, n))
        docs.append((n * 10 + 9, " ".join(r.sample(item, len(item)))))
    found = leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(items)], "item_id BIGINT, text STRING"))
    got = {(x.doc_id, x.item_id) for x in found.where("leaked").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert found.where("leaked AND longest_run < needed").count() > 60  # the alignment decides, not the longest run


def test_passes_over_large_test_sets(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ITEM), (2, "nothing of it")], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(n, f"{ITEM} number {n}") for n in range(20)], "item_id BIGINT, text STRING")
    monkeypatch.setattr("lorespark.llm.leaks.SMALL_SET", 100)
    assert {x.item_id for x in leaks(docs, items).where("leaked").collect()} == set(range(20))


def test_align():
    assert align("a b x c d".split(), "a b c d".split()) == (7, 2, 5)


def brute(rows):
    out = set()
    key = lambda x: "".join(c for c in x.upper().lower() if c.isalpha())
    by = {}
    for i, s, t in rows:
        if s is not None and t is not None and i is not None:
            by.setdefault(s, []).append((i, t))
    for members in by.values():
        df = {}
        for i, t in members:
            for k in {key(x) for x in t.split("\n")}:
                df[k] = df.get(k, 0) + 1
        for i, t in members:
            out |= {(i, n) for n, x in enumerate(t.split("\n"), 1) if key(x) and df[key(x)] >= 5 and df[key(x)] >= 0.1 * len(members)}
    return out


def test_repeated_lines(spark):
    rows = [(i, "s", f"Title {chr(97 + i % 26) * (i % 7 + 3)}\nBy Anna {chr(65 + i % 26)}lk\nShare  this page!\n{i} people\n\n" + ("SHARE this, page\n" if i % 2 else "") + f"body{'xyz'[i % 3] * i}") for i in range(40)]
    rows += [(100, "s", None), (101, None, "Share this page"), (102, "s", ""), (103, "t", "Share this page"), (1, "s", "Share this page")]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "raw_id BIGINT, source_name STRING, text STRING, line_no INT, cluster STRING")
    found = repeated_lines(df)
    assert {(r.raw_id, r.line_no) for r in by_letters(found).collect()} == brute(rows)
    assert found.where("line_no = 2 AND line_rows < 5").count() >= 40  # bylines differ by name only, so the cluster goes
    clean = {r.raw_id: r.text for r in without_lines(df.where("raw_id = 0"), found).collect()}
    assert "hare" not in clean[0] and "By Anna" not in clean[0] and "Title" in clean[0]
    assert repeated_lines(df.limit(0)).isEmpty()


def test_cluster_recall(spark):
    """Of all pairs of forms of a source that are similar enough, nine tenths at least are in one cluster; what nothing connects is not."""
    r = random.Random(3)
    made = []
    for n in range(60):
        base = ["".join(r.choices("abcdefgh", k=5)) for _ in range(40)]
        for _ in range(8):
            ws = list(base)
            ws[r.randrange(40)] = "x" + str(r.randrange(99)).translate(str.maketrans("0123456789", "abcdefghij"))
            made.append((f"s{n % 3}", " ".join(ws)))
    made = sorted(set(made))
    forms = spark.createDataFrame([(s, i, f) for i, (s, f) in enumerate(made)], "source_name STRING, f BIGINT, form STRING")
    of = {x.f: x.cluster for x in clusters(forms).collect()}
    grams = [{*f.split(), *map(" ".join, zip(f.split(), f.split()[1:], strict=False))} for _, f in made]
    near = [(i, j) for i in range(len(made)) for j in range(i) if made[i][0] == made[j][0] and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    assert len(near) > 500 and sum(of[i] == of[j] for i, j in near) >= 0.9 * len(near)
    assert len(set(of.values())) >= 55 and len(of) == len(made)


def test_lines_of_one_row_each_are_repeated_together(spark):
    """Small edits of one notice, each in one row alone and of a form of its own."""
    ws = "please note that this page is kept for reference only and that its contents may change without any further notice to readers who use it in their own work or pass it on to others in print".split()
    odd = [*"abcdefghijkl"]
    rows = [(n, "s", "body " + c * 9 + "\n" + " ".join(c * 6 if i == n else w for i, w in enumerate(ws))) for n, c in enumerate(odd)]
    found = repeated_lines(spark.createDataFrame(rows, "raw_id BIGINT, source_name STRING, text STRING"))
    assert {(r.raw_id, r.line_no, r.held, r.line_rows) for r in found.collect()} == {(n, 2, len(odd), 1) for n in range(len(odd))}
    assert by_letters(found).isEmpty()


def test_all_similar_pairs(spark, monkeypatch):
    """As a brute force has them, at the threshold too, whether a gram is crowded or not."""
    r, made = random.Random(4), set()
    for _ in range(60):
        base = [r.choice("abcdefghijklmno") * 3 for _ in range(r.randrange(1, 30))]
        for _ in range(6):
            ws = list(base)
            for _ in range(r.randrange(3)):
                ws[r.randrange(len(ws))] = r.choice("abcdefghijklmnopq") * 3
            made.add((r.choice("st"), " ".join(ws + [r.choice("xyz")] * r.randrange(2))))
    made = sorted(made)
    forms = spark.createDataFrame([(s, i, f) for i, (s, f) in enumerate(made)], "source_name STRING, f BIGINT, form STRING")
    grams = [{*f.split(), *zip(f.split(), f.split()[1:], strict=False)} for _, f in made]
    want = {(j, i) for i in range(len(made)) for j in range(i) if made[i][0] == made[j][0] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])}
    assert len(want) > 60
    for share in (1000, 7):
        monkeypatch.setattr(repeats, "FORMS_OF_A_SHARE", share)
        assert {tuple(x) for x in similar_pairs(forms).collect()} == want


def test_masked_form():
    assert masked_form("Last updated 12 March 2024 by Anna Smith") == masked_form("Last updated 3 June 2021 by Hugo Brown")
