"""Merkle manifest, periodic runs and byte-level BPE against plain Python versions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlab.llm import byte_bpe, merkle, periodic_runs, queries
from textlab.llm.arrays import text_bytes
from textlab.llm.queries import BYTE_BPE, split_pattern, tokenizer_path, with_planted_periods

from .conftest import SCHEMA, ascii_lower, prose, texts_of

NAMES = ["awkward", "small", "empty"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- Merkle manifest ----------------------------------------------------------


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests):
    """(root, proof as [(left, right)] of each leaf)"""
    proofs, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for proof, at in zip(proofs, places):
            run = level[at // 16 * 16:at // 16 * 16 + 16]
            proof.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        places = [at // 16 for at in places]
        level = [sha("".join(level[i:i + 16])) for i in range(0, len(level), 16)]
    return level[0], proofs


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)"""
    groups = {}
    for i, text, lang, source, n in rows:
        low = None if text is None else ascii_lower(text)
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        leaf = plain_leaf(i, source, lang, n, text)
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, plain_leaf(i, source, lang, n, low) if tampered else leaf, i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[s])]) for s in order]
    root, tops = plain_tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for s, (subroot, proofs), top in zip(order, trees, tops):
        for (_, _, leaf, shown, i), proof in zip(sorted(groups[s]), proofs):
            node = shown
            for left, right in proof + top:
                node = sha(left + node + right)
            out.append((i, leaf, subroot, root, sha("".join(a + b for a, b in proof + top)), node, node == root))
    return out


def merkle_query(df, monkeypatch, spark):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return queries.op11_merkle(spark, "")


def shaped(sizes):
    return [(1000 * k + i if i % 7 else None, prose(i, 3) if i % 5 else "É A", "en", f"s{k}" if k else None, i)
            for k, n in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("name", [*NAMES, "one", "lone groups", "tall", "one group", "many groups"])
def test_manifest(name, request, spark, monkeypatch):
    shapes = {"one": [1], "lone groups": [1, 1, 1], "tall": [700, 1, 16, 17, 0, 256], "one group": [300], "many groups": [2] * 300}
    df = spark.createDataFrame(shaped(shapes[name]), SCHEMA).repartition(6) if name in shapes else request.getfixturevalue(name)
    if name == "tall":
        monkeypatch.setattr(merkle, "HOT", 4)  # hot targets are dealt out to copies
    got = merkle_query(df.withColumn("tree", F.lit(1)), monkeypatch, spark)
    want = plain_manifest(df.select("doc_id", "text", "lang", "source", "n_chars").collect())
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_manifest_of_repeated_rows(spark, monkeypatch):
    rows = [(5, "Same", "en", "s", 4)] * 40 + [(None, None, None, None, None)] * 20 + [(5, "Other", "en", "s", 4)] * 3
    got = merkle_query(spark.createDataFrame(rows, SCHEMA), monkeypatch, spark).collect()
    want = plain_manifest(rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_proof_leads_to_the_root_and_only_from_its_leaf(spark):
    df = spark.createDataFrame(shaped([40, 3]), SCHEMA)
    out = merkle.manifest(df, "doc_id", "source", [F.col("doc_id"), F.col("text")]).collect()
    assert all(r.verified and r.folded_root == r.root for r in out)
    for r in out:
        node = "0" * 64
        for s in r.proof:
            node = sha(s.left + node + s.right)
        assert node != r.root


# -- periodic runs ------------------------------------------------------------


def plain_runs(w, min_length=24, exponent=3):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(min_length, exponent * q) and not any(
                    all(w[k] == w[k + d] for k in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def plain_row(words, runs):
    best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    stay = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(stay))


def test_word_runs_equal_brute_force():
    r, total = random.Random(3), 0
    for _ in range(600):
        kinds, n = r.choice([1, 2, 3, 5, 40]), r.randint(0, 200)
        w = [b"%d" % r.randrange(kinds) for _ in range(n)]
        for _ in range(r.randint(0, 4) if n else 0):
            a, p, length = r.randrange(n), r.randint(1, 40), r.randint(1, 150)
            for i in range(a + p, min(n, a + length)):
                w[i] = w[i - p]
        if r.random() < 0.3 and n:
            w = w + w[:r.randrange(n)] + w
        min_length, exponent = r.choice([(24, 3), (24, 3), (6, 3), (9, 4)])
        want = plain_runs(w, min_length, exponent)
        assert periodic_runs.word_runs(w, min_length, exponent) == want
        total += len(want)
    assert total > 300


def test_squares_hold_every_period():
    r = random.Random(8)
    for _ in range(200):
        w = [r.randrange(r.choice([1, 2, 3])) for _ in range(r.randint(1, 40))]
        found = set(periodic_runs.squares(w))
        assert all(w[e - 2 * p + 1:e - p + 1] == w[e - p + 1:e + 1] for e, p in found)
        for s, n, q in plain_runs(w, 2, 2):
            assert {(e, q) for e in range(s + 2 * q - 1, s + n)} <= found


@pytest.mark.parametrize("name", NAMES)
def test_periodic_runs(name, request):
    df = request.getfixturevalue(name)
    got = {r[0]: tuple(r[1:]) for r in periodic_runs.periodic_runs(with_planted_periods(df.select("doc_id", "text"))).collect()}
    want = {}
    for i, text in texts_of(df).items():
        words = plain_words(i, text)
        long = len(words) > 1500  # brute force is quadratic; there the word version, tested above, stands in
        want[i] = plain_row(words, periodic_runs.word_runs(words) if long else plain_runs(words))
    assert got == want
    if name == "small":
        assert sum(v[0] > 0 for v in got.values()) > 50


def test_runs_of_awkward_rows(spark):
    cycle = " ".join(["a b", "c"] * 40)
    rows = [(1, None), (1, None), (None, cycle), (3, ""), (4, " \n\t"), (5, "x " * 23), (6, "x\x0b" * 24), (7, "é b " * 30),
            (8, " ".join(str(i % 9000) for i in range(30000))), (9, cycle.upper())]
    df = spark.createDataFrame([(a, b, 7, "kept") for a, b in rows], "doc_id long, text string, `START` int, other string")
    out = periodic_runs.periodic_runs(df, with_spans=True)
    assert out.columns[:2] == ["doc_id", "other"] and "START" not in out.columns
    got = out.select("doc_id", "n_runs", "start", "length", "period", "collapsed", "other").collect()
    assert sorted((str(r.doc_id), r.n_runs, r.start, r.length, r.period) for r in got) == sorted([
        ("1", 0, None, None, None), ("1", 0, None, None, None), ("None", 1, 0, 120, 3), ("3", 0, None, None, None),
        ("4", 0, None, None, None), ("5", 0, None, None, None), ("6", 1, 0, 24, 1), ("7", 1, 0, 30, 1),
        ("8", 1, 0, 30000, 9000), ("9", 1, 0, 120, 3)])
    assert {r.collapsed for r in got if r.doc_id is None} == {"a b c"} and {r.other for r in got} == {"kept"}


# -- byte-level BPE -----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = byte_bpe.Vocabulary(tokenizer_path(BYTE_BPE)).rank
    return tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(tokenizer_path(BYTE_BPE), split_pattern())


def encoded(encoder, texts):
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    ids, sizes = encoder(data, offsets)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def random_texts(seed, n):
    r = random.Random(seed)
    white = " \t\n\x0b\f\r\x85      　\x1c\x1f​"
    kinds = [lambda: chr(c) if not 0xD800 <= (c := r.randrange(0x110000)) < 0xE000 else "",
             lambda: r.choice("ab cdeéÉñ日本語 \n\t'stllİ़क१23²½.,!<|endoftext|> ՘\U000323b0౜" + white),
             lambda: r.choice(white + "  a.’“"), lambda: r.choice("abcdefgh"), lambda: chr(r.randrange(0x20, 0x3000))]
    return ["".join(kind() for _ in range(r.choice([3, 30, 90, 700]))) for kind in r.choices(kinds, k=n)]


def test_ids_equal_the_library(encoder, library):
    texts = [*random_texts(1, 1500), "x" * 5000, "ab" * 900, " " * 3000 + "a", "", "don't", "日本語" * 300, prose(3, 400), "İKİNCİ, का तक़,"]
    assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]
    encoder.words.clear()
    assert encoded(encoder, texts[::-1]) == [library.encode_ordinary(t) for t in texts[::-1]]


def test_characters_newer_than_the_library_are_no_letters(encoder, library):
    texts = [x + chr(c) + y for a, b in byte_bpe.NEWER for c in (a, b) for x, y in (("a", "a"), (" ", "1"), ("1", "é"))]
    assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_merge_in_the_same_order(library):
    vocabulary, r = byte_bpe.Vocabulary(tokenizer_path(BYTE_BPE)), random.Random(4)
    for n in (2, 3, 40, 500, 900):
        piece = "".join(r.choice("abestin") for _ in range(n))
        matrix = byte_bpe.merge_matrix(vocabulary, vocabulary.byte_ids[np.frombuffer(piece.encode(), np.uint8)][None].copy())
        assert byte_bpe.merge_long(vocabulary, piece.encode()).tolist() == matrix[0][1][0].tolist()


def test_store_forgets_and_stays_right(encoder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_STRINGS", 50)
    for k in range(5):
        texts = [prose(100 * k + i, 60) for i in range(5)]
        assert encoded(encoder, texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_byte_bpe_query(name, request, library, spark, monkeypatch):
    df = request.getfixturevalue(name)
    monkeypatch.setattr(queries, "table", lambda *_: df.select("doc_id", "text"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_byte_bpe(spark, "").collect()}
    want = {}
    for i, t in texts_of(df).items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
    assert got == want


def test_encode_and_decode_awkward_rows(spark, library):
    texts = [None, None, "", "é a  b", "same", "same", "word " * 60000]
    rows = [(i if i != 4 else None, t, 1, "kept") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `IDS` int, other string")
    out = byte_bpe.encode(df, tokenizer_path(BYTE_BPE), split_pattern())
    assert out.columns == ["doc_id", "other", "ids", "n_tokens", "ids_sha256"]
    back = byte_bpe.decode(out, tokenizer_path(BYTE_BPE)).withColumn("decoded", F.col("decoded").cast("string"))
    assert sorted(r.decoded for r in back.collect()) == sorted(t or "" for t in texts)
    given = spark.createDataFrame([(1, None), (2, []), (3, [int(library.encode_ordinary("日")[0])])], "k int, ids array<int>")
    assert {r.k: bytes(r.decoded) for r in byte_bpe.decode(given, tokenizer_path(BYTE_BPE)).collect()} == {
        1: b"", 2: b"", 3: library.decode_single_token_bytes(library.encode_ordinary("日")[0])}
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [999999])], "k int, ids array<int>"), tokenizer_path(BYTE_BPE)).collect()
