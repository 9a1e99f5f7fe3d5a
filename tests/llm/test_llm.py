"""The operators of the training-data pipeline against brute force on small tables."""

from __future__ import annotations

import hashlib
import html as entities
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartwork.llm import linededup
from chartwork.llm.common import Words, components, shingle_sets
from chartwork.llm.decontamination import best_edit, drop_leaks, find_leaks
from chartwork.llm.extraction import extract_text, main_blocks
from chartwork.llm.fingerprints import canonical, digest, edited_text, fingerprint_documents
from chartwork.llm.jaccard import jaccard_components, near_duplicates_dropped
from chartwork.llm.langid import fit_languages, identify, predict_languages
from chartwork.llm.linededup import dedup_lines
from chartwork.llm.mixing import exact_weights, integer_weights, mix_sources, mixed, phases, pieces, schedule
from chartwork.llm.queries import ORACLES, QUERIES
from chartwork.llm.sharding import SlotMap, shard_documents, slot_totals
from chartwork.llm.substrings import align, chain, repeated_passages
from chartwork.llm.warc import canonical_url, cut_by_time, resolve_revisits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Copies, near copies, shared lines and passages, empty, null and long texts, ties and repeated rows."""
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(30, 120)) for _ in range(30)]
    line = "  A Line that MANY documents repeat, with some forty letters or more\t"
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0", 0) for i in range(8)]
    for i in range(12):
        w = base[1].split()
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((200 + i, " ".join(w), "de", "s1", 0))
    rows += [(300 + i, f"{base[i + 2]}\n{line}\nshort\n{line.strip().lower()}", "fr", "s2", 0) for i in range(7)]
    passage = sentence(rng, 60)
    rows += [(400 + i, f"{sentence(rng, 20)} {passage} {sentence(rng, 20)}", None, None, 0) for i in range(5)]
    rows += [(500, None, "en", "s0", None), (501, "", "en", "s0", 0), (502, " \n\t ", None, "s9", 3), (503, "one two", "en", "s0", 7), (504, "One  two", "en", "s0", 8), (505, "1234 !!", "en", "s1", 7)]
    rows += [(506, sentence(rng, 30_000, 9000), "en", "s0", 0), (507, "ß É ﬁ x", "de", "s1", 0), (507, "ß É ﬁ x", "de", "s1", 0), (508, "word " * 300, "en", "s1", 0)]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def got(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark, docs):
    return frame(spark, docs)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """The same rows with columns whose names the operators use inside."""
    extra = "id long, h long, token long, shard int, slot int, a long, b long, chain long, block int, lang_pred string, score double, piece int"
    return frame(spark, [(*r, *[7] * 9, "x", 0.5, 1) for r in docs], f"{SCHEMA}, {extra}")


# ---------------------------------------------------------------- shared pieces


def test_words_and_shingles():
    texts = ["A b  C", None, "", "  ", "x\ty z é", "one two three four five six two"]
    w = Words(pa.array(texts))
    assert w.counts().tolist() == [len(words_of(t)) for t in texts]
    again = Words(pa.array(["a B c"]))
    assert w.hash[:3].tolist() == again.hash.tolist()
    part = Words(pa.array(texts).slice(4, 2))
    assert part.hash.tolist() == w.hash[3:].tolist()
    sets, edge = shingle_sets(w, 5)
    assert np.diff(edge).tolist() == [1, 0, 0, 0, 1, 3]
    long = Words(pa.array(["y" * 3_000_000 + " z", "z"]))
    assert long.hash[1] == long.hash[2] and len(long.hash) == 3


def test_components(spark):
    edges = frame(spark, [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    want = [(i, 0) for i in range(1, 31)] + [(i, 100) for i in range(101, 103)]
    assert got(components(edges), "id", "component") == sorted(want, key=repr)


# ---------------------------------------------------------------- 1 line dedup


def lines_by_hand(rows):
    where = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc, text, *_ in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= 40 and doc is not None:
                where[key(x)].add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < 5 or max(where[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, table, odd, monkeypatch):
    cols = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got(dedup_lines(table), *cols) == lines_by_hand(docs)
    assert got(dedup_lines(odd, batches=7), *cols) == lines_by_hand(docs)
    rows = [*docs, (None, docs[40][1], None, None, 0), (None, "\n".join([docs[-20][1] or ""]), None, None, 0)]
    assert got(dedup_lines(frame(spark, rows)), *cols) == lines_by_hand(rows)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_line_runs_compact(spark, docs, tmp_path):
    rows = frame(spark, docs)
    plain = got(linededup.repeated_lines(rows, batches=1), "h", "l", "holder")
    assert plain == got(linededup.repeated_lines(rows, batches=8), "h", "l", "holder") and plain
    store = linededup.LineRuns(spark, tmp_path.as_uri(), fanout=2)
    for b in range(5):
        store.add(frame(spark, [(b, 0, 1, 9 - b), (99, 9, 1, 9 - b)], "h long, l long, n_docs long, holder long"))
    assert [len(x) for x in store.levels] == [1, 0, 1] or sum(map(len, store.levels)) <= 3
    assert got(store.counts().where("h = 99"), "holder", "n_docs") == [(9, 5)]


# ---------------------------------------------------------------- 2 sharding


def test_sharding(spark, docs, table, odd):
    rows = shard_documents(table, 40).collect()
    assert len(rows) == len(docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(40))
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert got(shard_documents(odd, 40), "doc_id", "shard", "slot") == got(shard_documents(table, 40), "doc_id", "shard", "slot")
    assert shard_documents(frame(spark, []), 40).count() == 0
    assert shard_documents(frame(spark, [(None, "a", None, None, 0), (None, None, None, None, 0)]), 3).count() == 2


def test_slot_map_is_edited(spark, tmp_path):
    rng = np.random.default_rng(1)
    load = rng.integers(0, 10_000, 8192)
    first = SlotMap.initial(40)
    second = first.rebalanced(load)
    size = np.bincount(second.shard, weights=load)
    assert size.max() - size.min() <= 2
    assert np.mean(np.array(first.shard) == second.shard) > 0.5 and second.version == 2
    grown = second.grown()
    moved = [(a, b) for a, b in zip(second.shard, grown.shard, strict=True) if a != b]
    assert {b for _, b in moved} == {40} and len(moved) == 8192 // 41
    for m in (first, second, grown):
        m.save(spark, str(tmp_path / "maps"))
    assert SlotMap.load(spark, str(tmp_path / "maps")) == grown
    assert SlotMap.load(spark, str(tmp_path / "maps"), 2) == second


# ---------------------------------------------------------------- 3 revisits


def test_revisits(spark):
    rows = [
        (1, "http://www.a.org/x/?utm_source=q#f", 10, 200, {"etag": '"1"', "content-length": "5", "date": "d1"}),
        (2, "https://A.org:443/x", 20, 200, {"etag": '"2"', "last-modified": "m", "content-length": "6"}),
        (3, "http://a.org/x", 15, 304, {"etag": 'W/"1"', "date": "d3", "content-length": "0"}),
        (4, "http://a.org/x", 25, 304, {"etag": '"1"'}),
        (5, "http://a.org/x", 26, 304, {"last-modified": "m"}),
        (6, "http://a.org/x", 27, 304, None),
        (7, "http://b.org/", 5, 304, {"etag": '"9"'}),
        (8, "http://b.org", 6, 200, {}),
        (9, None, 7, 304, {}),
        (10, "http://a.org/x", 10, 304, {"etag": '"1"'}),
        (11, "http://a.org/x", 12, 404, {}),
    ]
    schema = "record_id long, url string, ts long, status int, headers map<string,string>"
    for chunks, least in ((1, 1), (3, 1), (256, 1), (256, 10_000)):
        found = {r["revisit_id"]: r for r in resolve_revisits(frame(spark, rows, schema), chunks, least).collect()}
        assert {k: (r["target_id"], r["outcome"]) for k, r in found.items()} == {3: (1, "resolved"), 4: (2, "mismatch"), 5: (2, "resolved"), 6: (2, "unchecked"), 7: (None, "orphan"), 9: (None, "orphan"), 10: (1, "resolved")}
        assert found[3]["headers"] == {"etag": 'W/"1"', "content-length": "5", "date": "d3"}
        assert found[4]["headers"] == rows[1][4] and found[7]["headers"] is None
    assert resolve_revisits(frame(spark, [], schema)).count() == 0


def test_crowded_urls_are_cut_where_their_captures_are(spark):
    """One URL with many captures in a short span, beside a capture that is far away in time; ties, and a null time."""
    rng = random.Random(8)
    rows = [(i, "http://h/a", None if i == 0 else 10**9 + i // 2, rng.choice((200, 304, 304)), {"etag": str(rng.randrange(2))}, 0) for i in range(3000)]
    rows.append((5000, "http://h/b", 1, 200, {"etag": "1"}, 0))
    captures = frame(spark, rows, "record_id long, url string, ts long, status int, headers map<string,string>, canonical int")
    timed = captures.select("record_id", canonical_url().alias("canonical"), F.col("ts").cast("double").alias("_t"))
    cut = {(r["canonical"], r["_chunk"]): r["count"] for r in cut_by_time(timed, 50, 1000).groupBy("canonical", "_chunk").count().collect()}
    crowded = [n for (u, _), n in cut.items() if u == "h/a"]
    assert len(crowded) == 51 and max(crowded) < 150 and cut["h/b", 0] == 1
    want, last = {}, None
    for i, _, _, status, headers, _ in rows[:3000]:
        if status == 200:
            last = (i, headers["etag"])
        else:
            want[i] = (last and last[0], "orphan" if last is None else "resolved" if last[1] == headers["etag"] else "mismatch")
    found = resolve_revisits(captures, 50, 1000).collect()
    assert {r["revisit_id"]: (r["target_id"], r["outcome"]) for r in found} == want


# ---------------------------------------------------------------- 4 language ID


def test_language_id(spark, table, odd):
    rng = random.Random(1)
    roots = {"aa": "lorem ipsum dolor", "bb": "kraft werk zug", "cc": "éàü ôeuvre çela"}
    rows = []
    for i in range(300):
        lang = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rng.choice(roots[lang].split()) for _ in range(12)), lang, None, 0))
    rows += [(1000, None, "aa", None, 0), (1001, "", None, None, 0), (1002, "12 34", None, None, 0), (1003, "L", None, None, 0), (None, "lorem ipsum", None, None, 0)]
    found = {r["doc_id"]: r for r in predict_languages(frame(spark, rows)).collect()}
    assert all(found[i]["lang_pred"] == rows[i][2] for i in range(300))
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    # held-out labels are never used
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else g, s, n) for i, t, g, s, n in rows]
    assert got(predict_languages(frame(spark, other)), "doc_id", "lang_pred", "score") == got(predict_languages(frame(spark, rows)), "doc_id", "lang_pred", "score")
    assert predict_languages(odd).count() == table.count()
    assert identify(odd, fit_languages(odd)).columns[:5] == odd.columns[:5]
    assert predict_languages(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in predict_languages(frame(spark, [(1, "abc", None, None, 0)])).collect()} == {"und"}


# ---------------------------------------------------------------- 5 decontamination


def edits_by_hand(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_decontamination(spark, docs, odd):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(15, 50), 5000)) for i in range(20)]
    rows = list(docs)
    for k, (_, t) in enumerate(items):
        w = t.split()
        for _ in range(k % 5):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
        rows.append((1000 + k, f"{sentence(rng, 30)} {' '.join(w).upper() if k % 2 else ' '.join(w)}\n{sentence(rng, 30)}", "en", "s0", 0))
    rows.append((None, items[0][1], "en", "s0", 0))
    bench = frame(spark, [*items, (90, None), (91, ""), (92, "too short"), (None, "x y z a b c"), items[3]], "item_id long, text string")
    want = set()
    for doc, text, *_ in rows:
        for i, t in items:
            w, x = t.split(), words_of(text)
            if len(x) < 5000 and edits_by_hand(w, x) <= 0.2 * len(w) + 1e-9:
                want.add((doc, i))
    found = find_leaks(frame(spark, rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 15
    for r in found:
        text = words_of(next(t for d, t, *_ in rows if d == r["doc_id"]))
        part = text[r["first_word"] : r["first_word"] + r["n_words"]]
        item = next(t for i, t in items if i == r["item_id"]).split()
        assert edits_by_hand(item, part) == r["edits"] == edits_by_hand(item, text)
    leaky = {d for d, _ in want}
    assert sorted(d for d, in got(drop_leaks(frame(spark, rows), bench), "doc_id")) == sorted(r[0] for r in rows if r[0] not in leaky)
    assert drop_leaks(odd, bench).columns == odd.columns and drop_leaks(odd, bench).count() == len(docs)
    assert find_leaks(frame(spark, []), bench).count() == 0
    assert drop_leaks(frame(spark, docs), bench.limit(0)).count() == len(docs)
    assert best_edit(np.array([1, 2, 3], np.uint64), np.array([9, 1, 3, 9], np.uint64))[0] == 1


def test_short_items_are_found_as_they_are(spark):
    texts = ["one two three four", "Two three", "two  three two three", "three two", "", None, "two\nthree five"]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    items = spark.createDataFrame([(1, "two three"), (2, "TWO THREE"), (3, "five"), (4, ""), (5, None), (6, "one two three four")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["first_word"], r["n_words"], r["edits"]) for r in find_leaks(docs, items).collect()}
    pairs = {(i, k, words_of(t).index("two"), 2, 0) for i, t in enumerate(texts) for k in (1, 2) if i in (0, 1, 2, 6)}
    assert found == pairs | {(6, 3, 2, 1, 0), (0, 6, 0, 4, 0)}
    assert drop_leaks(docs, items).count() == len(texts) and drop_leaks(docs, items, min_words=4).count() == len(texts) - 1


def test_lines_are_hashed_once(spark, monkeypatch):
    from chartwork.llm import linededup

    made, calls = linededup._hashes, []
    monkeypatch.setattr(linededup, "_hashes", lambda n: calls.append(n) or made(n))
    rows = [(k, f"{'same line ' * 5}\n{'own ' * 12}{k}", None, None, 0) for k in range(6)] + [(9, None, None, None, 0)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got == {**{k: (2, int(k < 5)) for k in range(6)}, 9: (1, 0)} and calls == [linededup.MIN_CHARS]


# ---------------------------------------------------------------- 6 substrings


def test_substrings(spark, docs, table, odd):
    found = repeated_passages(table).collect()
    words = {d: words_of(t) for d, t, *_ in docs}
    grams = defaultdict(set)
    for d, w in words.items():
        for k in range(len(w) - 49):
            grams[tuple(w[k : k + 50])].add(d)
    need = set().union(*(s for s in grams.values() if len(s) > 1))
    have = {r["doc_id"] for r in found} | {r["ref_doc_id"] for r in found}
    assert need and need <= have
    for r in found:
        a, b = words[r["doc_id"]][r["first_word"] : r["end_word"]], words[r["ref_doc_id"]][r["ref_first"] : r["ref_end"]]
        assert min(len(a), len(b)) >= 50 and r["similarity"] >= 0.8 and r["doc_id"] != r["ref_doc_id"]
        assert sum((Counter(a) & Counter(b)).values()) >= 0.8 * max(len(a), len(b)) - 1
    clean = {i for i in range(9, 30)}
    assert not clean & have
    key = lambda rows: sorted((r["doc_id"], r["ref_doc_id"], r["first_word"]) for r in rows)
    assert key(repeated_passages(odd).collect()) == key(found)
    assert repeated_passages(frame(spark, [])).count() == 0


def test_passages_whose_parts_are_elsewhere(spark):
    rng = random.Random(11)
    p = sentence(rng, 80, 10**6).split()
    pad = lambda n=20: sentence(rng, n, 10**6).split()
    texts = {1: pad() + p[:40] + pad(), 2: pad() + p[40:] + pad(), 3: pad() + p + pad(), 4: pad() + p + pad()}
    # runs of one word: a short one first, then long ones
    texts |= {11: ["x"] * 12 + pad(), 12: ["x"] * 90 + pad(), 13: pad() + ["x"] * 90}
    # words left out in the middle, more than a band is wide at first; a long passage with seeds in its middle only
    q = sentence(rng, 400, 10**6).split()
    texts |= {21: pad() + q + pad(), 22: pad() + q[:150] + pad(8) + q[150:200] + q[208:] + pad()}
    changed = [w if i % 5 else w + "y" for i, w in enumerate(q[:100])]
    texts |= {31: pad() + changed + p[:30] + changed[::-1] + pad(), 32: pad() + [w.replace("y", "z") for w in changed] + p[:30] + changed[::-1] + pad()}
    found = repeated_passages(frame(spark, [(k, " ".join(w), None, None, 0) for k, w in texts.items()])).collect()
    spans = {(r["ref_doc_id"], r["doc_id"]): r for r in found}
    assert {(3, 4), (12, 13), (21, 22), (31, 32)} <= set(spans)
    assert spans[3, 4]["end_word"] - spans[3, 4]["first_word"] >= 79
    assert spans[12, 13]["end_word"] - spans[12, 13]["first_word"] >= 90
    assert max(r["end_word"] - r["first_word"] for r in found if (r["ref_doc_id"], r["doc_id"]) == (21, 22)) >= 390


def test_a_shared_run_whose_parts_all_have_earlier_documents(spark):
    """Words 0-48 and 11-59 of a run are in one document each: every seed of 30 words leads to one of these."""
    rng = random.Random(31)
    rows, want = [], set()
    for k in range(5):
        p = sentence(rng, 60, 10**6).split()
        pad = lambda: sentence(rng, 30, 10**6).split()
        texts = [pad() + p[:49] + pad(), pad() + p[11:] + pad(), pad() + p + pad(), pad() + p + pad()]
        rows += [(10 * k + i, " ".join(t), None, None, 0) for i, t in enumerate(texts)]
        want.add((10 * k + 3, 10 * k + 2))
    assert want <= {(r["doc_id"], r["ref_doc_id"]) for r in repeated_passages(frame(spark, rows)).collect()}


def test_a_long_stretch_of_few_words_makes_few_rows(spark):
    """A pair, or ten words, again and again: all of it is in passages, but not once more for each period."""
    rng = random.Random(32)
    pad = lambda: sentence(rng, 30, 10**6).split()
    few = sentence(rng, 10, 10**6).split()
    texts = {1: pad() + ["x", "y"] * 32 + pad(), 2: pad() + ["x", "y"] * 300 + pad(), 11: pad() + few * 8 + pad(), 12: pad() + few * 60 + pad()}
    found = repeated_passages(frame(spark, [(k, " ".join(w), None, None, 0) for k, w in texts.items()])).collect()
    for a, b, p in ((1, 2, 2), (11, 12, 10)):
        own = [r for r in found if (r["ref_doc_id"], r["doc_id"]) == (a, b)]
        covered = set().union(*(range(r["first_word"], r["end_word"]) for r in own))
        assert set(range(30, 630 - p)) <= covered and len(own) < 150


def test_long_passages_are_extended(spark):
    """A passage whose seeds are far from its ends: every sixth word differs there."""
    rng = random.Random(12)
    core = sentence(rng, 60, 10**6).split()
    wing = sentence(rng, 300, 10**6).split()
    rows = []
    for d in (1, 2):
        own = [w if i % 6 else f"{w}{d}" for i, w in enumerate(wing)]
        rows.append((d, " ".join(sentence(rng, 30, 10**6).split() + core + own + sentence(rng, 30, 10**6).split()), None, None, 0))
    (r,) = repeated_passages(frame(spark, rows)).collect()
    assert r["end_word"] - r["first_word"] > 350 and r["similarity"] > 0.8


def test_chain_and_align():
    x = np.array([0, 4, 8, 50, 12])
    y = np.array([10, 14, 18, 21, 22])
    assert (0, 18, 10, 28) in chain(x, y)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1000, 120)
    b = np.concatenate([rng.integers(0, 1000, 15), a[:50], a[53:80], [5, 6], a[80:]])
    x0, x1, y0, y1, same = align(a, b, 12, 15)
    assert x1 - x0 > 110 and y1 - y0 > 110 and same > 0.9
    assert align(a, a, 0, 0) == (0, 120, 0, 120, 1.0)
    assert align(a, a + 5000, 0, 0) is None


def test_the_kept_map_is_edited(spark, table, tmp_path):
    path = f"{tmp_path}/maps"
    shard_documents(table, 5, n_slots=64, maps_path=path).count()
    one = SlotMap.load(spark, path)
    assert one.version == 2 and SlotMap.load(spark, path, 1) == SlotMap.initial(5, 64)
    more = table.unionByName(frame(spark, [(9000 + i, "word " * (i + 1), None, None, 0) for i in range(200)]))
    load, _ = slot_totals(more, n_slots=64)
    shard_documents(more, 5, n_slots=64, maps_path=path).count()
    two = SlotMap.load(spark, path)
    assert two.version == 3 and two == one.rebalanced(load)
    totals = np.bincount(np.array(two.shard), weights=load, minlength=5)
    assert totals.max() - totals.min() <= load.max()
    with pytest.raises(ValueError, match="the kept map"):
        shard_documents(table, 6, n_slots=64, maps_path=path)


# ---------------------------------------------------------------- 7 extraction


def test_extraction(spark):
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div><!-- no --><article><h1>Head</h1><p><b>One &amp; two&nbsp;\n three<br><p>x&lt;y</p><aside>side</aside><form>f</form><div class="comments"><p>hi</p></div></article><div id="comments"><article class="comment">c</article></div><footer>foot</footer></body></html>'
    assert main_blocks(page) == ["Head", "One & two three", "x<y"]
    assert main_blocks(page[: page.index("x&lt;y") + 3]) == ["Head", "One & two three", "x&l"] or main_blocks(page[: page.index("x&lt;y")]) == ["Head", "One & two three"]
    assert main_blocks('<div class="ad">open<article>in</article>') == ["in"]
    assert main_blocks(None) == main_blocks("") == []
    assert main_blocks("plain 1 < 2 text") == ["plain 1 < 2 text"]
    notice = "all visitors of this site must read this very long notice here"
    own = [sentence(random.Random(i), 12, 10**6) for i in range(5)]
    bare = [(i, f"http://h.org/{i}", f"<body><div>{notice}</div><p>{own[i]}</p></body>") for i in range(5)]
    rows = [*bare, (10, "http://h.org/a", page), (11, None, None), (12, "http://other.org/", f"<p>{notice}</p>"), (10, "http://h.org/a", page), (None, "u", "")]
    found = extract_text(frame(spark, [(*r, 1) for r in rows], "page_id long, url string, html string, run int"))
    texts = defaultdict(list)
    for r in found.collect():
        texts[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(texts[i] == [own[i]] for i in range(5))
    assert texts[10] == ["Head\nOne & two three\nx<y"] * 2 and texts[11] == [""] and texts[None] == [""]
    assert texts[12] == [notice]
    assert extract_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_attributes_are_read_whole():
    def within(x):
        return main_blocks(f"<body><nav>menu</nav><article>{x}</article><footer>f</footer></body>")

    assert within('<p title="hidden gems">a</p><p data-id="related">b</p><p data-role="menu">c</p>') == ["a", "b", "c"]
    assert within('<p>x <a href="https://h/?id=share">a</a> <a href="/t?hidden">b</a></p>') == ["x a b"]
    assert within('<section class="notice">a</section><table class="widget"><tr><td>b</td></tr></table>') == ["a", "b"]
    gone = ('class="notice"', 'class="x ad-slot-2"', "class='share-buttons'", "class=reader-comments", "hidden", 'aria-hidden="true"', 'style="display: none"', 'id="related-posts"')
    assert within("<p>a</p>" + "".join(f"<div {x}>gone</div>" for x in gone)) == ["a"]
    assert main_blocks('<body><div class="share-price">a</div><div class="main-nav">gone</div></body>') == ["a"]
    # a teaser is no article; an element left open doesn't swallow one
    assert main_blocks("<main>real text<aside class=related><article>teaser</article></aside></main>") == ["real text"]
    assert main_blocks("<body><div>a longer real text</div><aside><article>teaser</article></aside></body>") == ["a longer real text"]
    assert main_blocks("<body><nav><a>m</a><article><p>whole article text</p></article></body>") == ["whole article text"]


def test_hosts_without_articles(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for host in range(3):
        furniture = [sentence(rng, n, 10**6) for n in (7, 12, 30)]
        for i in range(6):
            own = [sentence(rng, 15, 10**6) for _ in range(3)]
            comment = "<!-- <article> -->" if i == 0 else "<script>x = '<article>'</script>" if i == 1 else ""
            parts = [furniture[0], own[0], furniture[1] + " " + own[1], own[2], furniture[2]]
            page = 100 * host + i
            rows.append((page, f"https://h{host}.org/{i}", comment + "".join(f"<div>{x}</div>" for x in parts)))
            want[page] = "\n".join(own)
    found = extract_text(frame(spark, rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == want


def test_repeats_of_hosts_cut_no_sentence(spark):
    rng = random.Random(11)
    say = {n: [sentence(rng, n, 10**6) for _ in range(40)] for n in (5, 15, 20, 40)}
    rows, want = [], {}

    def page(key, host, blocks, text, url=None):
        rows.append((key, url or f"https://{host}.org/{key}", "".join(b if b.startswith("<") else f"<div>{b}</div>" for b in blocks)))
        want[key] = "\n".join(text)

    # a short block of three pages goes, a sentence that starts like others stays; two pages share no short block
    for i in range(6):
        page(i, "a", ["Read more here", f"<p>{say[15][i]}</p>"], [say[15][i]])
    # pages of which most is common count as copies
    for i in range(80, 86):
        page(i, "i", ["Read more here", f"<p>body text is unique {i}</p>"], ["Read more here", f"body text is unique {i}"])
    for i in range(10, 12):
        page(i, "b", ["Read more here", say[15][i]], ["Read more here", say[15][i]])
    # sentences that differ in one number
    for i in range(20, 24):
        body = f"{say[20][0]} {i} {say[20][1]}"
        page(i, "c", [body, say[5][i]], [body, say[5][i]])
    # a host of two pages loses its long furniture, at the start of a block and as a block, in <main> too
    for i in range(30, 32):
        parts = [say[15][0], f"{say[15][1]} {say[20][i]}", say[20][i - 10]]
        page(i, "d", ["<main>", *parts, "</main>"] if i == 31 else parts, [say[20][i], say[20][i - 10]])
    # copies at two urls, and a page fetched again, keep their text
    for i in range(40, 42):
        page(i, "e", [say[40][0], say[15][2], say[20][2]], [say[40][0], say[15][2], say[20][2]])
    for i in range(50, 52):
        page(i, "f", [say[40][i - 40], say[15][3]], [say[40][i - 40], say[15][3]], "https://f.org/x")
    # headings that pages share are theirs; what is a footer elsewhere goes where it is not marked
    for i in range(60, 64):
        page(i, "g", ["<h2>Introduction</h2>", say[20][i - 50]], ["Introduction", say[20][i - 50]])
    for i in range(70, 73):
        foot = f"<footer>{say[15][5]}</footer>" if i < 72 else say[15][5]
        page(i, "h", [f"<article>{say[40][i - 60]}</article>{foot}" if i < 72 else say[40][i - 60], *([] if i < 72 else [foot])], [say[40][i - 60]])
    rows = [(k, u, h if h.startswith("<") else f"<div>{h}</div>") for k, u, h in rows]
    found = extract_text(frame(spark, rows, "page_id long, url string, html string").repartition(5))
    assert {r["page_id"]: r["text"] for r in found.collect()} == want


def test_names_in_camel_case():
    assert main_blocks('<body><p>a</p><div class="cookieBanner">gone</div><div id="sponsoredContent">gone</div><div class="sharePrice">b</div></body>') == ["a", "b"]


def test_extraction_of_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert main_blocks(r["html"]) == [p for p in parts if p]


# ---------------------------------------------------------------- 8 mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 500, "b": 333, "c": 166, "d": 1}])
def test_schedule_is_pfair(weights):
    total, run = sum(weights.values()), Counter()
    order = schedule(weights)
    assert Counter(order) == Counter(weights)
    for t, s in enumerate(order, 1):
        run[s] += 1
        assert all(abs(run[x] - w * t / total) < 1 for x, w in weights.items())


def test_mixing(spark, docs, table, odd):
    rows = mix_sources(table, block_rows=4).collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((d[0] for d in docs), key=repr)
    counts = Counter(d[3] or "" for d in docs)
    weights = integer_weights({s: n**0.5 for s, n in counts.items()})
    blocks = {(r["slot"], r["source"], r["block"]) for r in rows}
    order = [s for _, s, _ in sorted(blocks)]
    assert [x for x, *_ in sorted(blocks)] == list(range(len(blocks)))
    by = defaultdict(list)
    for r in rows:
        by[r["source"], r["block"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    left, run, t = {s: -(-n // 4) for s, n in counts.items()}, Counter(), 0
    for s in order:
        run[s] += 1
        t += 1
        total = sum(weights[x] for x in left)
        assert all(abs(run[x] - weights[x] * t / total) < 1 for x in left)
        left[s] -= 1
        if not left[s]:
            del left[s]
            run, t = Counter(), 0
    assert mix_sources(frame(spark, [])).count() == 0
    out = mixed(odd, block_rows=4)
    assert out.columns == odd.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(d[0] for d in docs)
    assert mix_sources(table, {"s0": 1, "s1": 2, "s2": 3, "s9": 4, "": 5}).count() == len(docs)
    with pytest.raises(ValueError, match="no target weight"):
        mix_sources(table, {"s0": 1})


def test_phases_cover_all_blocks():
    blocks = {"a": 5, "b": 40, "c": 0}
    plan = phases(blocks, {"a": 2, "b": 1, "c": 1})
    assert [p[0] for p in plan] == [0, 8] or plan[0][0] == 0
    assert plan[-1][3] == ["b"]


def test_pieces_keep_the_exact_share():
    target = {"hot": 139.58, **{f"s{i}": 45.29 for i in range(19)}, "rare": 0.01}
    blocks = {s: int(40 * w) + 1 for s, w in target.items()}
    at: dict[int, str] = {}
    have = Counter()
    for piece in pieces(blocks, exact_weights(target), 1000):
        for s, (first, own) in piece.items():
            assert first == have[s]
            have[s] += len(own)
            at |= dict.fromkeys(own, s)
    assert have == blocks and sorted(at) == list(range(sum(blocks.values())))
    left, run, t, whole = dict(blocks), Counter(), 0, sum(target.values())
    for slot in range(len(at)):
        run[at[slot]] += 1
        t += 1
        assert all(abs(run[x] - target[x] * t / whole) < 1 for x in left)
        left[at[slot]] -= 1
        if not left[at[slot]]:
            del left[at[slot]]
            run, t, whole = Counter(), 0, sum(target[x] for x in left)


def test_rare_source_keeps_its_share(spark, monkeypatch):
    monkeypatch.setattr("chartwork.llm.mixing.CHUNK_BLOCKS", 64)
    monkeypatch.setattr("chartwork.llm.mixing.PIECE_SLOTS", 150)
    monkeypatch.setattr("chartwork.llm.mixing.pieces", lambda b, w: pieces(b, w, 150))
    rows = [(i, "x", "en", "b" if i < 3 else "a", 1) for i in range(4003)]
    out = mix_sources(frame(spark, rows), {"a": 0.99999, "b": 0.00001}, block_rows=1).collect()
    assert sorted(r["slot"] for r in out) == list(range(4003))
    run = Counter()
    for t, r in enumerate(sorted(out, key=lambda r: r["slot"]), 1):
        assert r["block"] == run[r["source"]]
        run[r["source"]] += 1
        assert run["a"] == 4000 or abs(run["b"] - 0.00001 * t) < 1


# ---------------------------------------------------------------- 9 Jaccard join


def groups_by_hand(rows):
    sets = []
    for _, text, *_ in rows:
        w = words_of(text)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            o = len(sets[x] & sets[y])
            if o and ids[x] is not None and ids[y] is not None and 100 * o >= 80 * (len(sets[x]) + len(sets[y]) - o):
                a, b = sorted((top(ids[x]), top(ids[y])))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in zip(ids, sets, strict=True)), key=repr)


def test_jaccard(spark, docs, table, odd):
    cols = ("doc_id", "n_shingles", "component_id")
    want = groups_by_hand(docs)
    assert got(jaccard_components(table), *cols) == want
    assert got(jaccard_components(odd), *cols) == want
    assert len({c for _, _, c in want}) < len(want) - 15
    rows = [*docs, (None, docs[0][1], None, None, 0)]
    assert got(jaccard_components(frame(spark, rows)), *cols) == groups_by_hand(rows)
    assert jaccard_components(frame(spark, [])).count() == 0
    kept = near_duplicates_dropped(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in want if i == c)


def test_jaccard_crowded_columns(spark):
    """Large groups around several centres: more than one pivot is needed, and chains link step by step."""
    rng = random.Random(4)
    rows, at = [], 0
    shared = sentence(rng, 40).split()
    for _ in range(4):
        own = sentence(rng, 100).split()
        for _ in range(15):
            w = shared + own
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((at, " ".join(w), None, None, 0))
            at += 1
    chain_ = sentence(rng, 120).split()
    for _ in range(20):
        chain_ = [*chain_[4:], *sentence(rng, 4).split()]
        rows.append((at, " ".join(chain_), None, None, 0))
        at += 1
    rng.shuffle(rows)
    assert got(jaccard_components(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == groups_by_hand(rows)


# ---------------------------------------------------------------- 10 fingerprints


def test_fingerprints(spark, docs, table, odd):
    order = sorted(docs, key=lambda r: (r[0], r[1] or ""))
    want = []
    for k, (d, t, *_) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = edited_text(t, n)
        assert e == t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        p, q = digest(canonical(t)), digest(canonical(e))
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, float(p == q), float(p == digest(canonical(n)))))
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    found = fingerprint_documents(table)
    assert got(found, *cols) == sorted(want, key=repr)
    assert got(fingerprint_documents(odd), *cols) == sorted(want, key=repr)
    least = {}
    for d, t, *_ in order:
        least.setdefault(canonical(t), d)
    assert {(r["doc_id"], r["group_id"]) for r in found.collect()} == {(d, least[canonical(t)]) for d, t, *_ in docs}
    one = fingerprint_documents(frame(spark, [(5, "abc", None, None, 0)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"aba").hexdigest()
    assert fingerprint_documents(frame(spark, [])).count() == 0
    assert fingerprint_documents(frame(spark, [(None, "a", None, None, 0), (None, None, None, None, 0), (3, "a", None, None, 0)])).count() == 3


def test_canonical_form():
    assert canonical("  Ｆｕｌｌ　width ﬁ STRASSE straße ") == "full width fi strasse strasse"
    assert canonical(unicodedata.normalize("NFD", "É")) == canonical("é")


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(ORACLES[name])
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(df.columns) == sorted(want.columns)
    assert got(df, *want.columns) == sorted(want.fetchall(), key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stay = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    comp = {i: c for i, _, c in groups_by_hand(stay)}
    stay = [r for r in stay if comp[r[0]] == r[0]]
    stay = [r for r in stay if not any(edits_by_hand(w, words_of(r[1])) <= 0.2 * len(w) + 1e-9 for w in items)]
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in stay)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    load, n = slot_totals(docs)
    assert n.sum() == len(out) and load.sum() == sum(len((t or "").encode()) + 16 for _, t in stay)


def test_mixing_decides_the_slots(spark, table):
    import corpus_pipeline
    from chartwork.llm.common import written

    def sharded(df):
        out = defaultdict(list)
        for r in sorted(corpus_pipeline.sharding(spark, df, "").collect(), key=lambda r: r["slot"]):
            assert r["slot"] == len(out[r["shard"]])
            out[r["shard"]].append(r["doc_id"])
        return out

    rows = table.where("doc_id is not null").dropDuplicates(["doc_id"])
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in mix_sources(rows).collect()}
    with_stage, without = sharded(written(corpus_pipeline.mixing(spark, rows, ""), "mixed")), sharded(written(rows.orderBy("doc_id"), "plain"))
    assert all(v == sorted(v, key=place.get) for v in with_stage.values())
    assert {k: set(v) for k, v in with_stage.items()} == {k: set(v) for k, v in without.items()} and with_stage != without
    assert sharded(corpus_pipeline.mixing(spark, rows, "")) == with_stage
    assert corpus_pipeline.sharding(spark, frame(spark, []), "").count() == 0


def test_ends_without_hope_end_where_the_table_does():
    from chartwork.llm import substrings

    rng, told = random.Random(1), 0
    for _ in range(1500):
        size = rng.choice([5, 20, 60, 400])
        x, y = (np.array([rng.randrange(size) for _ in range(rng.randrange(1, 90))], np.int32) for _ in range(2))
        if rng.random() < 0.5:
            k = rng.randrange(20)
            y = np.concatenate([y[:k], x[k // 2 : k // 2 + rng.randrange(5, 30)], y[k:]])
        if x[0] == y[0] or any(substrings._resumes(x, i, y, j) for i, j in substrings.STEPS):
            continue
        if substrings._hopeless(x, y):
            told += 1
            found = substrings._table(x, y)
            assert found[:3] == (0, 0, 0) and not found[4]
    assert told > 100


def test_chains_of_one_diagonal_are_one():
    from chartwork.llm.substrings import _by_diagonal, alignments

    assert sorted(_by_diagonal([(0, 9, 5, 14, 5, 5), (50, 60, 55, 65, 5, 5), (1, 2, 9, 10, 8, 8), (3, 30, 4, 33, 1, 3)])) == [(0, 60, 5, 65, 5, 5), (1, 2, 9, 10, 8, 8), (3, 30, 4, 33, 1, 3)]
    rng = np.random.default_rng(2)
    x = rng.integers(0, 10**6, 400).astype(np.int32)
    y = x.copy()
    y[:20] += 10**7
    y[90:200] += 10**7  # two passages on the diagonal, apart
    y[330:] += 10**7
    got = sorted(alignments(x, y, 0, 0, (30, 320), 30, 50))
    assert [g[:2] for g in got] == [(20, 90), (200, 330)]


@pytest.mark.parametrize("changed", [0.05, 0.1])
def test_recall_of_changed_passages(spark, changed):
    """Passages of 60 to 120 words of which a part is changed, against an alignment of the whole texts."""
    rng, rows, pairs = random.Random(int(changed * 100)), [], []
    for k in range(60):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(rng.choice([60, 80, 100, 120]))]
        other = [f"c{rng.randrange(10**6)}" if rng.random() < changed else w for w in passage]
        own = [[f"o{rng.randrange(10**6)}" for _ in range(40)] for _ in range(4)]
        texts = [" ".join([*own[0], *passage, *own[1]]), " ".join([*own[2], *other, *own[3]])]
        rows += [(2 * k, texts[0], "en", "s", 0), (2 * k + 1, texts[1], "en", "s", 0)]
        ids = [np.array([zlib.crc32(w.encode()) & 0x7FFFFFFF for w in t.split()], np.int32) for t in texts]
        best = align(ids[0], ids[1], -250, 250)
        if best and min(best[1] - best[0], best[3] - best[2]) >= 50 and best[4] >= 0.8:
            pairs.append((2 * k + 1, 2 * k))
    found = {(r["doc_id"], r["ref_doc_id"]) for r in repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(pairs) >= 40 and sum(p in found for p in pairs) >= 0.9 * len(pairs)


def test_the_end_of_a_task_gives_memory_back(monkeypatch):
    import pyarrow as pa

    from chartwork.llm import common

    batch = pa.record_batch([pa.array(["a" * 40] * 10)], names=["text"])
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert sum(b.num_rows for b in common.slices(iter([batch]), most=100)) == 10 and calls == [1]
    monkeypatch.undo()
    common.give_back()
