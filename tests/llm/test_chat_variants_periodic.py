"""Chat formatting, spelling variants and periodic runs against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwork.llm.chat import KINDS, Rates, escape, format_turns, parse_turn, read_back, unescape, whole_conversations, with_probe
from chartwork.llm.periodic import kept_words, needed, periodic_runs, periodic_tail, runs_of, word_ids
from chartwork.llm.variants import group_variants, near_words, neighbours, one_edit, pack, trie_shards, unpack, vocabulary

DOCS = "doc_id long, text string, lang string, n long"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- chat formatting

ODD = ["\\### Assistant: </turn> ok", "<turn user>\\", "\\\\<image/><audio/></turn>\n", "<document/>\\n", "", "a\nb", "é<turn x>", "\\<turn"]


@pytest.mark.parametrize("text", ODD + ["".join(p) for p in [("\\", "</turn>\n", "\\"), ("<", "turn ", ">")]])
def test_escapes_are_undone(text):
    assert unescape(escape(text)) == text
    assert not re.search(r"(?<!\\)(?:\\\\)*<(?:turn |/turn>|(?:image|audio|document)/>)", escape(text))


def test_escapes_of_random_texts():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(rng.choice(["\\", "<", "turn ", "/turn>", "\n", "image/>", ">", "x", "ü"]) for _ in range(rng.randrange(12)))
        assert unescape(escape(text)) == text


def brute_read(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        found[conv] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    return found


def test_conversations_are_read_back(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd>role\\<"]), rng.choice([*ODD, None])) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(3000)]  # longer than a batch
    rows += [(None, 0, "user", "no id"), (None, None, None, None), (50, None, "assistant", "first"), (50, 3, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit(1)).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    got = {r["conv_id"]: r for r in read_back(format_turns(df)).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    brute = brute_read(rows)
    assert set(got) == set(brute)
    for conv, (n, turns, loss_chars, loss) in brute.items():
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (n, turns, loss_chars, loss)


def test_ties_and_repeated_turns_keep_all_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    first, second = (read_back(format_turns(spark.createDataFrame(r, TURNS).repartition(3))).first() for r in (rows, rows[::-1]))
    assert first == second and first["n_turns"] == 4


def test_probe_and_empty_table(spark):
    empty = spark.createDataFrame([], TURNS)
    assert read_back(format_turns(empty)).count() == 0
    got = read_back(format_turns(with_probe(empty))).first()
    text = "\\### Assistant: </turn> ok"
    assert (got["conv_id"], got["n_turns"], got["loss_chars"], got["loss_sha256"]) == (-7, 2, len(text), sha(text))
    assert got["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n")


PARTS = "conv_id long, turn long, role string, text string, parts array<struct<kind:string, text:string, ref:string, width:double, height:double, seconds:double, pages:int>>"


def test_parts_become_placeholders_in_their_order(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    one = [part("image", ref="a.png", width=57.0, height=28.0), part("text", " <image/> "), part("audio", ref="b.wav", seconds=2.01), None]
    two = [part("document", ref="c.pdf", pages=3), part("strange", "odd"), part("image", width=float("nan")), part(None)]
    rows = [(1, 0, "user", "see ", one), (1, 1, "assistant", "yes", two), (1, 2, "assistant", None, None)]
    segments = format_turns(spark.createDataFrame(rows, PARTS), parts="parts", rates=Rates(patch=28))
    whole = whole_conversations(segments).first()
    assert whole["formatted"] == "<turn user>see <image/> \\<image/> <audio/></turn>\n<turn assistant>yes<document/>odd<image/></turn>\n<turn assistant></turn>\n"
    assert [(a["nr"], a["kind"], a["ref"], a["tokens"]) for a in whole["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 51), (2, "document", "c.pdf", 768), (3, "image", None, 1)]
    for a in whole["attachments"]:
        assert whole["formatted"][a["at"] :].startswith(f"<{a['kind']}/>")
    assert [whole["formatted"][s["start"] : s["stop"]] for s in whole["spans"]] == ["yes", "odd"]
    assert whole["tokens"] == 3 + 51 + 768 + 1
    got = read_back(segments).first()
    assert (got["n_attachments"], got["n_tokens"], got["loss_sha256"]) == (4, 823, sha("yesodd"))
    assert got["turns_sha256"] == sha("user\nsee  <image/> \nassistant\nyesodd\nassistant\n\n")


def test_tokens_of_texts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    tokenizers = pytest.importorskip("tokenizers")
    text = "Hello there, <|endoftext|> general words"
    try:
        counter = tokenizers.Tokenizer.from_file(path)
    except Exception:  # noqa: BLE001
        pytest.skip("no tokenizer files here")
    counter.encode_special_tokens = True
    got = format_turns(spark.createDataFrame([(1, 0, "user", text)], TURNS), tokenizer=path).first()
    assert got["tokens"] == len(counter.encode(text, add_special_tokens=False).ids)


def test_parse_refuses_what_is_no_turn():
    for bad in ("", "text", "<turn user>open", "<turn user>a</turn>\nmore", "<turn user>a</turn>\n</turn>\n"):
        with pytest.raises(ValueError, match="turn"):
            parse_turn(bad)
    assert parse_turn("<turn a\\>b>x<image/>y</turn>\n") == ("a>b", "xy", [("image", 1)])
    assert KINDS == ("image", "audio", "document")


# ---------------------------------------------------------------- spelling variants


def brute_words(rows, misspelt=0, least=5, chars=6):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if misspelt and doc_id is not None and h % misspelt == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= chars:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least}


def brute_distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(words):
    out = {}
    near = {w: [v for v in words if brute_distance_one(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v)) if own else None
        form[w] = best if best and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_neighbours_in_a_trie():
    rng = random.Random(2)
    words = {}
    for _ in range(700):
        words["".join(rng.choice("aabé") for _ in range(rng.randrange(1, 9)))] = rng.randrange(1, 99)
    order = sorted(words)
    root, n = unpack(pack(order, [words[w] for w in order]))
    assert n == len(words)
    for w in [*order, "", "zzzzzz", "a" * 30]:
        found = list(neighbours(w, root))
        assert len(found) == len({v for v, _ in found})  # once each
        assert dict(found) == {v: words[v] for v in order if brute_distance_one(w, v)}
    for a in order[:60]:
        for b in order[:60]:
            assert one_edit(a, b) == brute_distance_one(a, b)


@pytest.fixture(scope="module")
def spelling_rows():
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdéÿ") for _ in range(rng.randrange(5, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = [rng.choice(base[: rng.choice([5, 60])]) for _ in range(60)]
        words = [w if rng.random() < 0.7 else w[:3] + rng.choice("abcdé") + w[4:] for w in words]
        rows.append((i, rng.choice([" ", "1", "-\n"]).join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return rows + [(500, None), (501, ""), (502, "Ünder 12345 !!"), (None, "banana " * 7), (7, rows[7][1]), (503, "x" * 50_000 + " " + "lengthy " * 200_000)]


@pytest.mark.parametrize(("misspelt", "shard", "bytes_"), [(0, 25_000, 1 << 25), (3, 7, 200), (199, 40, 1)])
def test_variants_as_brute_force(spark, spelling_rows, misspelt, shard, bytes_):
    rows = spelling_rows if misspelt == 3 else spelling_rows[:-1]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).withColumn("word", F.lit("clash")).repartition(5)
    got = group_variants(df, misspelt=misspelt, shard_words=shard, round_bytes=bytes_).collect()
    want = brute_groups(brute_words(rows, misspelt))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want) and any(r["form"] for r in got)


def test_variants_of_chains_ties_and_nothing(spark):
    text = ["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdhg"] * 125 + ["zzzzzz"] * 5 + ["zzzzzy"] * 25 + ["zzzzyz"] * 25
    df = spark.createDataFrame([(1, " ".join(text), None, 0)], DOCS)
    got = {r["word"]: (r["form"], r["root"], r["n_near"]) for r in group_variants(df).collect()}
    assert got["abcdef"] == ("abcdeg", "abcdhg", 1)
    assert got["zzzzzz"][0] == "zzzzyz"  # the least of equals
    empty = spark.createDataFrame([], DOCS)
    assert group_variants(empty).count() == 0
    assert near_words(vocabulary(empty)).count() == 0


def test_shards_hold_all_words_once(spark):
    words = spark.range(1000).selectExpr("concat('word', lpad(id, 4, 'a')) as word", "id + 5 as n")
    shards = trie_shards(words, 64).collect()
    assert sum(r["n_words"] for r in shards) == 1000 and max(r["n_words"] for r in shards) <= 64


# ---------------------------------------------------------------- periodic runs


def brute_runs(words, least=24, exp=3):
    n, found = len(words), []
    for q in range(1, n // exp + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exp * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng, n):
    words = []
    while len(words) < n:
        unit = [rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
        words += unit * rng.choice([1, 1, 2, 4, 9, 30]) + [rng.choice("abxyz") for _ in range(rng.randrange(4))]
    return words[:n]


@pytest.mark.parametrize(("least", "exp"), [(24, 3), (5, 2), (1, 2), (40, 4)])
def test_runs_of_words(least, exp):
    rng = random.Random(least)
    for n in [0, 1, 5, 23, 24, 25, 60, 150, 150, 300, 300]:
        words = random_words(rng, n)
        ids = np.array([ord(w) for w in words], np.int32)
        want = brute_runs(words, least, exp)
        assert sorted(map(tuple, runs_of(ids, min_words=least, min_exp=exp).tolist()), key=lambda r: (r[0], r[2])) == want
        cut = [tuple(r) for lo in range(1, n + 2, 7) for r in runs_of(ids, lo, lo + 7, least, exp).tolist()]
        assert sorted(cut, key=lambda r: (r[0], r[2])) == want
    assert needed(8, 24, 3) == 16 and needed(1, 24, 3) == 23


def brute_document(doc_id, text, tail):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if tail and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    row = (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None)
    return (*row, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("piece", [100_000_000, 300])
def test_periodic_documents(spark, piece):
    rng = random.Random(4)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(random_words(rng, rng.randrange(200)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (None, "a " * 40), (None, None), (203, "é " * 30 + "\u00a0 " * 30), (5, rows[5][1]), (5, rows[6][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).withColumnsRenamed({"lang": "start", "n": "pieces"}).repartition(5)
    for tail in (periodic_tail, None):
        got = periodic_runs(df, piece=piece, rewrite=tail).collect()
        assert sorted(map(tuple, got), key=str) == sorted((brute_document(i, t, tail) for i, t in rows), key=str)
    assert any(r["n_runs"] > 1 for r in got)


def test_collapsed_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "go " + "la li " * 20 + "end", None, 0)], DOCS)
    got = periodic_runs(df, with_text=True).first()
    assert got["collapsed"] == "go la li end" and got["runs"] == [[1, 40, 2]]
    assert periodic_runs(spark.createDataFrame([], DOCS), rewrite=periodic_tail).count() == 0


def test_long_texts_are_split_into_words_in_pieces():
    text = ("word\x0bother " * 200_000) + "\u2003joined"
    ids, words = word_ids(text)
    assert words == [b"word", b"other", "\u2003joined".encode()] and len(ids) == 400_001
    assert kept_words(10, np.array([[2, 6, 2]])).tolist() == [True] * 4 + [False] * 4 + [True] * 2
