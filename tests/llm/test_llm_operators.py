"""The training-text operators against plain versions of themselves, on small and awkward tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowfind.llm import decontamination, embeddings, licenses, packing, quality, simhash, substrings, urls
from stowfind.llm.bpe import load, vocabulary
from stowfind.llm.common import components
from stowfind.llm.lines import line_dedup
from stowfind.llm.tokens import token_counts

# Names that operators use inside, as columns of the input.
EXTRA = "doc_id long, text string, shard int, fp long, hash string, label array<int>, score double, length long"


def words(n, seed, vocab=400):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocab)}" for _ in range(n))


def awkward():
    base = words(120, 1)
    lines = "\n".join(words(12, 100 + i) for i in range(12))
    return [
        (1, base), (2, base), (2, base), (2, base + " more"), (3, None), (4, ""), (None, base), (None, None),
        (5, " \t\n"), (6, base.replace("w1 ", "W1 ")), (7, base.upper()), (8, "é" * 60 + " straße ǅ １２ ²³ \u3000x"),
        (9, "a\x1cb\x85c\xa0d  \n\n e<|endoftext|>f " * 3), (10, words(4000, 2)), (11, lines),
        (12, "intro line here\n" + lines), (13, lines + "\nlast line here"), (14, "x" * 3000),
        (15, lines[: len(lines) // 2]), (16, "同じ文章が二度" * 20), (17, "同じ文章が二度" * 20 + "!"),
        (18, "released under the MIT  License. Apache-License, mit license"), (-5, base[:70]),
        (19, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        (20, "(GNU) General Public\tLicense and general public general public license"), (21, "a b"), (22, "a b c")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None, 7, None, None, 0.5, i) for i, (d, t) in enumerate(awkward())]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


# --- tokens and packing ---------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(docs, nothing, library):
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024)
            for d, t in awkward()]
    assert rows_of(token_counts(docs)) == sorted(want, key=repr)
    assert token_counts(nothing).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_vocabularies(docs, name):
    assert token_counts(docs, name).where("n_tokens > 0").count() > 10


def test_shortcuts_give_the_ids_of_the_library(library):
    bpe, draw = load("byte_bpe_50k.json"), random.Random(3)
    signs = "aZé ñ'stlld \n\t.,!_-0123Ω日²\x1c\xa0"
    for _ in range(400):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(40)))
        assert bpe.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in draw.sample(sorted(bpe.whole), 2000))


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_is_an_exact_round_trip(docs, library, size):
    pieces = packing.pack_documents(docs, size=size).collect()
    places, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] >= 1
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        texts[p["doc_id"], p["doc_tokens"]].append(p)
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    assert sorted(places) == list(range(len(places)))
    got = [(p["doc_id"], p["start"], struct.unpack(f"<{p['length']}I", p["ids"]), p["doc_tokens"]) for p in pieces]
    want = []
    for d, t in awkward():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(d, i, tuple(ids[i:i + size]), len(ids)) for i in range(0, len(ids), size)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    # Short of the last sequence, little is padded.
    assert len(places) <= 1 + 1.05 * sum(p["length"] for p in pieces) / size


def test_packing_has_one_plan_at_every_size(docs):
    plan = packing.pack_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


def test_patterns_hold_the_histogram_with_little_padding():
    draw = random.Random(4)
    histogram = {n: draw.randrange(1, 60) for n in range(1, 1025)} | {500: 100_000}
    patterns = packing.fill_patterns(histogram, 1024)
    held = defaultdict(int)
    for lengths, count in patterns:
        assert sum(lengths) <= 1024
        for n in lengths:
            held[n] += count
    assert dict(held) == histogram
    ids = sum(n * c for n, c in histogram.items())
    assert sum(c for _, c in patterns) * 1024 < 1.06 * ids  # pairs of 500 leave 24


# --- SimHash --------------------------------------------------------------------------------------------------------

def plain_fingerprint(text, k=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i], nodes[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(nodes))]


def test_simhash_components(docs, nothing):
    table = awkward()
    fps = [plain_fingerprint(t or "") for _, t in table]
    roots = plain_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {r: min((d for (d, _), q in zip(table, roots) if q == r and d is not None), default=None) for r in roots}
    want = [(d, f - (1 << 64) if f >> 63 else f, least[r]) for (d, _), f, r in zip(table, fps, roots)]
    assert rows_of(simhash.simhash_components(docs)) == sorted(want, key=repr)
    assert simhash.simhash_components(nothing).count() == 0


@pytest.mark.parametrize("hot", [2048, 3])
def test_close_fingerprints_are_all_linked(spark, hot):
    draw, fps = random.Random(5), set()
    for _ in range(25):
        center = draw.getrandbits(64)
        for _ in range(12):
            center ^= sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5)))
            fps.add(center - (1 << 64) if center >> 63 else center)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(4)
    found = simhash.block_edges(nodes, 6, 3, hot).collect()
    edges = {(r["a"], r["b"]) for r in found if r["a"] != r["b"]}
    burning = sorted({r["a"] for r in found if r["a"] == r["b"]})
    assert bool(burning) == (hot == 3)
    mask = (1 << 64) - 1
    if burning:
        hubs = simhash.hub_edges(spark.createDataFrame([(x,) for x in burning], "fp long"), 3)
        through = {(r["a"], r["b"]) for r in hubs.collect()}
        assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in through)
        edges |= through
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    roots = plain_components(fps, lambda a, b: ((a ^ b) & mask).bit_count() <= 3)
    assert [got.get(x, x) for x in fps] == [fps[r] for r in roots]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 300)] + [(5, k) for k in range(1000, 1200)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 301)} == {100} and {got[k] for k in range(1000, 1200)} == {5} and got[7] == 7
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------------

def plain_links(vectors, cosine=0.95):
    n, links = len(vectors), defaultdict(set)
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
            for v in vectors]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    return links


@pytest.mark.parametrize("block", [2048, 10])
def test_vector_links(spark, block):
    draw = np.random.default_rng(6)
    vectors = [v.tolist() for v in draw.standard_normal((250, 24)).astype(np.float32)]
    vectors += [(np.array(vectors[k % 20]) + s * draw.standard_normal(24)).astype(np.float32).tolist()
                for k, s in enumerate(np.linspace(0.02, 0.3, 80))]
    vectors += [vectors[0], vectors[0], [0.0] * 24, None, [], [float("nan")] + [1.0] * 23, [None] + [1.0] * 23,
                [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], (np.array(vectors[3]) * 2).astype(np.float32).tolist()]
    frame = spark.createDataFrame([(i, v, None, 1) for i, v in enumerate(vectors)],
                                  "vec_id long, embedding array<float>, label int, cid long").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.vector_links(frame, block=block).collect()}
    want = plain_links(vectors)
    total = sum(map(len, want.values()))
    assert len(got) == len(vectors)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * total
    assert all(got[i]["n_links"] <= len(want[i]) for i in got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert got[330]["component_id"] == 0 and got[331]["component_id"] == 0
    assert got[338]["n_links"] == 1 and got[339]["component_id"] == 338
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(332, 338))


def test_recall_of_vector_links(spark, small):
    frame = spark.read.parquet(small.replace("0.001", "0.1") + "/embeddings.parquet")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.vector_links(frame).collect()}
    want = plain_links_of_table(frame)
    assert sum(got.values()) >= 0.9 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def plain_links_of_table(frame):
    rows = frame.toPandas()
    x = np.array(rows["embedding"].tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return dict(zip(rows["vec_id"], ((x @ x.T >= 0.95).sum(axis=1) - 1).tolist()))


def test_vectors_of_nothing(spark):
    assert embeddings.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- licences -------------------------------------------------------------------------------------------------------

def plain_scan(text):
    w = licenses.plain_words(text or "")
    places, labels = [], set()
    for label, phrase in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best, more = (1.0 if places else 0.0), set(labels)
    for label, passage, phrase in licenses.TEMPLATES:
        p, k = passage.split(), phrase.split()
        start = next(i for i in range(len(p)) if p[i:i + len(k)] == k)
        for i in range(len(w)):
            if w[i:i + len(k)] == k:
                share = sum(0 <= i - start + j < len(w) and w[i - start + j] == x for j, x in enumerate(p)) / len(p)
                if share >= 0.5:
                    more.add(label)
                    best = max(best, share)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
            ",".join(sorted(more)), best)


def test_license_scan(docs, nothing):
    got = rows_of(licenses.license_scan(docs).drop("places"))
    assert got == sorted(((d, *plain_scan(t)) for d, t in awkward()), key=repr)
    found = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert found[18]["n_base"] == 3 and found[18]["base_labels"] == "apache,mit" and found[19]["labels"] == "bsd"
    assert [p["label"] for p in found[20]["places"]][:2] == ["gpl", "gpl"]
    assert licenses.license_scan(nothing).count() == 0


# --- URLs -----------------------------------------------------------------------------------------------------------

def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(r), r, v) for v, r in urls.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_verdicts(spark, small):
    pages = spark.read.parquet(small.replace("0.001", "0.01") + "/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "no scheme/es/"), (-4, "HTTP://A.NET/es/x?y#z"), (-5, "x://net"), (-6, "x://net/es/"),
           (-7, "x://www.Example.COM/en/a"), (-8, "x://a.www.example.com/en/"), (-9, "x://notnet/es/"), (None, "a://b.com/"),
           (-10, "a://com?x/es/"), (-11, "p://q://com/z"), (-12, "a://net/es"), (-12, "a://net/es")]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string")).withColumn("score", F.lit("x"))
    got = urls.url_verdicts(pages, trees=3).collect()
    plain = {(r["page_id"], r["url"]): plain_rule(r["url"]) for r in pages.collect()}
    assert len(got) == pages.count()
    for r in got:
        fitting = [p for (i, _), p in plain.items() if i == r["page_id"]]
        assert any((r["host"], r["path"], r["rule"]) == p[:3] and p[3] in (None, r["verdict"]) for p in fitting), r
        assert r["verdict"] in ("allow", "block") and 0 <= r["score"] <= 1
    labelled = [(r["verdict"], r["score"]) for r in got if r["rule"]]
    assert np.mean([(s >= 0.5) == (v == "block") for v, s in labelled]) > 0.7


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.url_verdicts(pages).collect()} == {"allow"}
    assert urls.url_verdicts(pages.limit(0)).count() == 0


# --- repeated substrings --------------------------------------------------------------------------------------------

def plain_removal(table, width):
    smallest = {}
    for d, t in table:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            if d is not None:
                smallest[b[p:p + width]] = min(smallest.get(b[p:p + width], d), d)
    out = []
    for d, t in table:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if d is not None and smallest[b[p:p + width]] < d:
                gone[p:p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "bucket_bytes": 5000, "lot_bytes": 400}])
def test_repeated_substrings(docs, sizes):
    got = substrings.repeats_removed(docs, **sizes).select("doc_id", "n_bytes", "n_removed", "n_spans",
                                                           F.sha2("kept", 256))
    assert rows_of(got) == plain_removal(awkward(), 50)


def test_periodic_and_shifted_texts(spark):
    draw = random.Random(8)
    table = [(i, "".join(draw.choice(["ab", "abc ", "aaaaaaaa", words(8, draw.randrange(6), 9)]) for _ in range(20)))
             for i in range(40)]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = substrings.repeats_removed(frame, shard_bytes=2000, bucket_bytes=3000, lot_bytes=600).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert rows_of(got) == plain_removal(table, 50)


def test_substrings_of_nothing(nothing):
    assert substrings.repeats_removed(nothing).count() == 0


@pytest.mark.parametrize("text", [b"banana", b"a", b"abab" * 30, b"\0\0a\0\0\0", bytes(range(256)), b"mississippi" * 9])
def test_suffix_array_and_common_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order, rank = substrings.suffix_array(data)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert order.tolist() == want and rank[order].tolist() == list(range(len(text)))

    def common(a, b):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        return n

    assert substrings.common_prefixes(data, order).tolist()[1:] == [common(a, b) for a, b in zip(want, want[1:])]


# --- quality --------------------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, small):
    folder = small.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert all(rows["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in rows["doc_id"]])
    out = rows[rows["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.97 and rows["score"].between(0, 1).all()


def test_quality_cases(spark, docs, nothing):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (10, 1, None), (14, 0, 0), (7, None, 0), (None, 0, 0), (8, 0, 0),
                                    (11, 1, 0), (12, 1, 0), (13, 1, 0), (16, 0, 0)], schema)
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == len(awkward()) and all(0 <= r["score"] <= 1 for r in scored)
    assert all((r["score"] >= 0.3) == bool(r["predicted"]) for r in scored)
    assert quality.quality_kept(docs, labels).columns == docs.columns
    assert quality.quality_scores(nothing, labels).count() == 0


# --- lines ----------------------------------------------------------------------------------------------------------

def signed_hash(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed & ((1 << 64) - 1))
    return h - (1 << 64) if h >> 63 else h


def plain_chunks(text):
    lines = (text or "").split("\n")
    h = [signed_hash(x.encode()) for x in lines]
    roll = [None] + [signed_hash(struct.pack("<q", b), signed_hash(struct.pack("<q", a))) for a, b in zip(h, h[1:])]
    big = (1 << 63) - 1
    at = [i for i in range(len(lines)) if roll[i] is not None and roll[i] < min(
        big if i < 1 or roll[i - 1] is None else roll[i - 1], big if i + 1 == len(lines) else roll[i + 1])]
    ends = sorted({*at, len(lines) - 1})
    return [lines[a:b + 1] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends)]


def plain_ranges(text):
    """(first, last) of the chunks of both families."""
    lines, start, out = (text or "").split("\n"), 0, []
    for chunk in plain_chunks(text):
        if sum(bool(x.strip(" ")) for x in chunk) > 2:
            out.append((start, start + len(chunk) - 1))
        start += len(chunk)
    at = [i for i, x in enumerate(lines) if x.strip(" ")]
    return out + list(zip(at, at[1:]))


def plain_dedup(table):
    first, count = {}, defaultdict(int)
    for d, t in table:
        lines, place = (t or "").split("\n"), -(1 << 63) if d is None else d
        for a, b in plain_ranges(t):
            key = "\n".join(lines[a:b + 1])
            count[key] += 1
            first[key] = min(first.get(key, place), place)
    out = []
    for d, t in table:
        lines, place, seen, gone = (t or "").split("\n"), -(1 << 63) if d is None else d, set(), set()
        for a, b in sorted(plain_ranges(t)):
            key = "\n".join(lines[a:b + 1])
            if count[key] > 1 and (first[key] != place or key in seen):
                gone |= set(range(a, b + 1))
            seen.add(key)
        places = sum(i + 1 not in gone for i in gone)
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t,
                    0 if t is None else len(lines), len(gone), places))
    return sorted(out, key=repr)


def test_line_dedup(docs, nothing):
    got = line_dedup(docs)
    assert got.columns[:len(docs.columns)] == docs.columns
    assert rows_of(got.select("doc_id", "text", "__n_lines", "__n_removed_lines", "__n_removed_chunks")) == plain_dedup(
        awkward())
    assert line_dedup(nothing).count() == 0


def test_line_dedup_withstands_shifts(spark):
    body = [words(6, 50 + i) for i in range(60)]
    table = [(1, "\n".join(body)), (2, "\n".join(["new"] + body[:30] + ["inserted"] + body[30:])), (3, "\n".join(body * 2))]
    got = {r["doc_id"]: r for r in line_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got[1]["__n_removed_lines"] == 0 and got[2]["__n_removed_lines"] == 60 and got[3]["__n_removed_lines"] == 120
    assert got[2]["text"] == "new\ninserted" and got[2]["__n_removed_chunks"] == 2


def test_line_dedup_finds_repeats_of_few_lines(spark):
    table, passages = [], [[words(14, 1000 + 3 * p + k, 5000) for k in range(3)] for p in range(200)]
    for p, passage in enumerate(passages):
        for copy in range(2):
            around = [words(9, 9000 + 20 * p + 10 * copy + k, 5000) for k in range(6)]
            table.append((2 * p + copy, "\n".join(around[:3] + passage + around[3:])))
    got = {r["doc_id"]: r["__n_removed_lines"] for r in line_dedup(
        spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {d: 3 * (d % 2) for d, _ in table}


def test_line_dedup_blank_lines_and_repeats_within(spark):
    table = [(1, "a\n\nb\nc"), (2, "x\na\n\nb\n\ny"), (3, "p\nq\np\nq\np\nq"), (4, "z\nz\nz"), (5, "\n\n\n"),
             (6, "\n\n\n"), (7, "a\nc"), (None, "m\nn"), (None, "m\nn"), (None, "k\nm\nn"), (8, "m\nn\no")]
    got = line_dedup(spark.createDataFrame(table, "doc_id long, text string"))
    assert rows_of(got) == plain_dedup(table)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[2] == "x\n\ny" and texts[3] == "p\nq" and texts[4] == "z" and texts[8] == "o" and texts[7] == "a\nc"


def test_line_dedup_takes_any_column_names(spark):
    schema = ("doc_id long, text string, `__chunks` int, `__lines` int, `__hashes` int, `__all` int, `__gone_doc` int, "
              "doc int, key1 int, hash int, `row` int, own int, gone int, `lines` int, `left` int, `a.b` int")
    rows = [(i, "one line\nand another\n" + str(i), *range(14)) for i in range(3)]
    got = line_dedup(spark.createDataFrame(rows, schema))
    assert got.columns[:16] == [x.strip("`") for x in
                                (f.rsplit(" ", 1)[0].strip() for f in schema.split(","))]
    assert sorted(tuple(r)[:2] for r in got.collect()) == [(0, rows[0][1]), (1, "1"), (2, "2")]
    assert all(tuple(r)[2:16] == tuple(range(14)) for r in got.collect())


def test_line_dedup_of_a_very_long_text(spark):
    body = [f"line {i} of {i * i}" for i in range(200_000)]
    table = [(1, "\n".join(body)), (2, "\n".join(["new", *body[::-1], *body[:10]]))]
    got = {r["doc_id"]: tuple(r)[2:] for r in line_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {1: (200_000, 0, 0), 2: (200_011, 10, 1)}


# --- decontamination ------------------------------------------------------------------------------------------------

def test_decontamination(spark):
    items = [(k, ". ".join(words(n, 900 + k, 5000) for _ in range(2)) + ".") for k, n in enumerate((9, 15, 25, 60))]
    items += [(4, None), (5, ""), (None, words(30, 77, 5000)), (6, items[0][1])]
    changed = items[3][1].split()
    changed = " ".join(x if i % 6 else "changed" for i, x in enumerate(changed))
    scrambled = items[3][1].split()
    random.Random(1).shuffle(scrambled)
    docs = [(i, words(300, i, 5000)) for i in range(30)]
    docs += [(100 + k, f"{words(200, k, 5000)} {t.upper()}\n{words(90, k + 5, 5000)}") for k, (_, t) in enumerate(items) if t]
    docs += [(200, changed), (201, " ".join(scrambled)), (202, None), (203, ""), (204, items[2][1]), (None, items[2][1]),
             (204, items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    frame = spark.createDataFrame([(d, t, 1, None) for d, t in docs], "doc_id long, text string, item_id int, overlap int")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame.repartition(3), benchmark).collect()]
    want = [(100, 0), (100, 6), (101, 1), (102, 2), (103, 3), (106, None), (107, 0), (107, 6), (200, 3), (204, 2),
            (204, 2), (None, 2)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    few = decontamination.contaminated(frame, benchmark, items_at_once=2)
    assert sorted(((r["doc_id"], r["item_id"]) for r in few.collect()), key=repr) == sorted(want, key=repr)
    clean = decontamination.decontaminated(frame, benchmark)
    assert clean.columns == frame.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(frame.limit(0), benchmark).count() == 0
    assert decontamination.contaminated(frame, benchmark.limit(0)).count() == 0
    assert decontamination.decontaminated(frame, benchmark.limit(0)).count() == len(docs)


def test_more_items_than_dimensions_are_all_found(spark):
    items = [(k, words(20, 4000 + k, 4000)) for k in range(40)]
    docs = [(k, f"{words(60, 8000 + k, 4000)} {t} {words(60, 9000 + k, 4000)}") for k, t in items]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string"), rank=8)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, k) for k, _ in items]


@pytest.mark.parametrize("share", [0.66, 0.7, 0.75, 0.8])
def test_paraphrases_inside_other_text_are_candidates(share):
    draw, vocab = random.Random(4), [f"w{i}" for i in range(3000)]
    items = [[draw.choice(vocab[:40]) if draw.random() < 0.4 else draw.choice(vocab) for _ in range(draw.randrange(18, 60))]
             for _ in range(60)]
    own = np.unique(decontamination.word_hashes([" ".join(x) for x in items])[0])
    of = decontamination.Numbers(own)
    numbers = [of.of(decontamination.word_hashes([" ".join(x)])[0]) for x in items]
    idf = np.full(len(own) + decontamination.OTHERS, 8.0)
    for i, w in enumerate(vocab):
        idf[of.of(decontamination.word_hashes([w])[0])] = 0.3 if i < 40 else 3 + i % 6
    rows = np.zeros((len(items), len(own)))
    for row, n in zip(rows, numbers):
        np.add.at(row, n, idf[n])
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    basis = np.linalg.svd(rows, full_matrices=False)[2].T
    sizes = np.array([decontamination.window_length(len(n)) for n in numbers])
    lot = decontamination.Lot(list(range(len(items))), numbers, [n[-3:] for n in numbers], own, idf,
                              basis.astype(np.float32), (rows @ basis).astype(np.float32),
                              [(int(s), np.flatnonzero(sizes == s)) for s in np.unique(sizes)])
    texts = []
    for k, (x, n) in enumerate(zip(items, numbers)):
        # The words of most weight are those that a paraphrase replaces; the answer is the last three words.
        gone = sorted(range(len(x) - 3), key=lambda i: -idf[n[i]])[:len(x) - math.ceil(share * len(x))]
        around = [[f"other{draw.randrange(10**6)}" for _ in range(60 + k % 8)] for _ in range(2)]
        texts.append(" ".join([*around[0], *(f"new{i}" if i in gone else w for i, w in enumerate(x)), *around[1]]))
    found = decontamination.Search(lot, 0.35, 0.8, 0.65).hits(texts)
    assert [k for k, hits in enumerate(found) if k not in hits] == []


def test_longest_common_subsequence():
    draw = random.Random(9)
    for _ in range(60):
        a, b = ([draw.randrange(6) for _ in range(draw.randrange(1, 90))] for _ in range(2))
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        assert decontamination.overlap(np.array(a), np.array(b)) == grid[-1][-1]
