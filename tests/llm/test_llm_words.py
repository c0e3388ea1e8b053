"""Language identification, spelling variants and tokenizer alignment against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stowfind.llm import alignment, languages, variants
from stowfind.llm.bpe import byte_letters, vocabulary

EXTRA = "doc_id long, text string, lang string, key string, n long, word string, block long, pairs string, draw long"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, g, None, 7, "w", 1, None, 2) for d, t, g in rows], EXTRA).repartition(parts)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- alignment ------------------------------------------------------------------------------------------------------

def awkward():
    draw = random.Random(5)
    signs = ["a", "Z", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "日", "本", "🙂", "👩‍👧", "'s", "'ll", ",", ".", "0", "12",
             " ", "　", "\x1c", "\x85", "ing ", " the", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "é", "\r\n"]
    rows = [(i, "".join(draw.choice(signs) for _ in range(draw.randrange(1, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id here"), (1002, "the same"), (1002, "the same"), (1003, "the same"),
             (1004, "with ▁ inside"), (1005, " "), (1006, "\n"), (1007, "x" * 3000), (1008, "\nWord\n Word \n"),
             (1009, "word " * 4000), (1010, "\x00 zero"), (1011, "﷽ ﷺ ½ ﬁ"), (1012, "trailing  \n ")]
    return rows


def plain_alignment(rows):
    """Whole texts by both libraries, decoded bytes only, all pairs of tokens compared."""
    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    back = {x: i for i, x in enumerate(byte_letters())}
    known = []
    for doc, text in rows:
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_parts = [bytes(back[c] for c in a.id_to_token(i)) for i in a_ids]
        b_parts = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
                   for p in map(b.id_to_piece, b_ids)]
        data = (" " + (text or "")).encode()
        if not text or b"".join(a_parts) != data or b"".join(b_parts) != data:
            known.append((doc, [], [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_parts]), np.cumsum([len(x) for x in b_parts])
        a_starts, b_starts = a_ends - [len(x) for x in a_parts], b_ends - [len(x) for x in b_parts]
        cuts = sorted(set(a_ends) & set(b_ends))
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, e in zip(a_ids, a_ends) if start < e <= cut) + "|"
                          + ",".join(str(i) for i, e in zip(b_ids, b_ends) if start < e <= cut))
            start = cut
        links = []
        for i in range(len(a_ids)):
            for j in np.flatnonzero((b_starts < a_ends[i]) & (b_ends > a_starts[i])):
                links.append((a_ids[i], b_ids[j]))
        known.append((doc, a_ids, b_ids, groups, links))
    held = Counter(p for *_, links in known for p in set(links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((doc, len(x), len(y), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
                    sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
                   for doc, x, y, groups, links in known), key=repr)


def test_alignment_equals_whole_texts_and_decoded_bytes(spark):
    rows = awkward()
    got = alignment.cross_alignment(frame(spark, [(d, t, None) for d, t in rows]))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == plain_alignment(rows)


def test_alignment_does_not_depend_on_blocks_and_memory(spark, monkeypatch):
    rows = awkward()
    tool = alignment.Aligner(A, B)
    assert tool.separable
    want = list(tool.align([t for _, t in rows]))
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    small = alignment.Aligner(A, B)
    assert [x for i in range(0, len(rows), 7) for x in small.align([t for _, t in rows[i:i + 7]])] == want
    whole = alignment.Aligner(A, B)
    whole.separable = False
    assert list(whole.align([t for _, t in rows])) == want


def test_alignment_of_nothing(spark):
    assert alignment.cross_alignment(frame(spark, [(1, "a", "b")]).where("false")).count() == 0
    only = alignment.cross_alignment(frame(spark, [(1, None, None), (2, "", None)]))
    assert rows_of(only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_units_join_to_the_text():
    for _, text in awkward():
        if text:
            assert "".join(alignment.UNIT.findall(" " + text)) == " " + text


# --- spelling variants ----------------------------------------------------------------------------------------------

def plain_counts(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode()) if doc is not None else 1
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_counts(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def edited(word, draw):
    i, c = draw.randrange(len(word) + 1), draw.choice("abcdefé×ÿ")
    return draw.choice([word[:i] + c + word[i:], word[:i] + word[i + 1:], word[:i] + c + word[i + 1:]])


def spelled():
    draw = random.Random(9)
    stems = ["".join(draw.choice("abcdefghéÀ") for _ in range(draw.randrange(6, 14))) for _ in range(60)]
    stems += ["aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abcdefgh", "abcdefghi", "xabcdefgh", "prefixprefixab"]
    pool = []
    for s in stems:
        once = edited(s, draw)
        pool += [s] * draw.choice([5, 25, 130, 700]) + [once] * draw.choice([1, 5, 26]) + [edited(once, draw)] * 5
    draw.shuffle(pool)
    rows = [(i, draw.choice([" ", "-", "\n", "3"]).join(pool[i * 40:i * 40 + 40])) for i in range(len(pool) // 40 + 1)]
    return rows + [(None, "abcdefgh " * 30), (5, None), (6, ""), (7, "12 34"), (8, rows[3][1]), (8, rows[3][1]),
                   (9, "AbcDefGh ÉCOLES écoles " * 50)]


def test_variants_equal_brute_force_and_sql(spark, tmp_path):
    rows = spelled()
    got = variants.spelling_variants(frame(spark, [(d, t, None) for d, t in rows]))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert sum(r[2] != r[1] and r[1] is not None for r in want) > 3  # chains of forms
    assert rows_of(got) == want
    engine = duckdb.connect()
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(engine.execute(variants.SQL).fetchall(), key=repr) == want


def test_letters_are_lost_by_rule(spark):
    rows = [(i, "wordsand") for i in range(4000)]
    got = {r["word"]: r["n"] for r in variants.counted_words(frame(spark, [(d, t, None) for d, t in rows])).collect()}
    assert got == plain_counts(rows) and 1 < len(got)


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(frame(spark, [(1, "a", None)]).where("false")).count() == 0
    assert variants.spelling_variants(frame(spark, [(1, None, None), (2, "short words", None)])).count() == 0


def test_pairs_of_a_frequent_half_are_not_all_formed(spark):
    draw = random.Random(2)
    words = sorted({"common" + "".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)})
    pairs = variants.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"))
    assert "CartesianProduct" not in (plan := pairs._jdf.queryExecution().executedPlan().toString())
    assert "NestedLoop" not in plan
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert got == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


# --- languages ------------------------------------------------------------------------------------------------------

SYLLABLES = {"en": ["th", "ing", "er", "and", "wh"], "de": ["ch", "ung", "ß", "ein", "sch"], "fr": ["é", "eau", "que", "ment"]}


def spoken():
    draw = random.Random(4)
    rows = []
    for i in range(400):
        lang = draw.choice(sorted(SYLLABLES))
        text = " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(draw.randrange(3, 90)))
        rows.append((i, text, lang))
    return rows


def test_languages_of_held_out_documents(spark):
    rows = spoken() + [(900, None, "en"), (901, "", "de"), (902, "123 %%", "de"), (None, "thing wher thand", "en"),
                       (903, "einsch ungch", None), (904, " ".join(["queeau ément"] * 60_000), None)]
    found = languages.languages(frame(spark, rows))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = found.collect()
    assert len(got) == len(rows)
    truth = {d: g for d, _, g in rows[:400]}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(tested) > 50 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in tested) >= 0.98 * len(tested)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, None, 903, 904)] == ["und", "und", "und", "en", "de", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got) and by_id[900]["score"] == 0
    again = languages.languages(frame(spark, rows[::-1], 2))
    assert {(r["doc_id"], r["lang_pred"]) for r in again.collect()} == {(r["doc_id"], r["lang_pred"]) for r in got}


def test_held_out_rows_are_never_learned(spark):
    rows = spoken()
    wrong = [(d, t, "en" if zlib.crc32(str(d).encode()) % 5 == 0 else g) for d, t, g in rows]
    assert rows_of(languages.languages(frame(spark, rows))) == rows_of(languages.languages(frame(spark, wrong)))


def test_kernels_are_shares_of_common_places():
    spectrum = languages.Spectrum(longest=3, slots=1 << 12, piece=50)
    texts = [t for _, t, _ in spoken()[:20]]
    points = [spectrum.landmark(t) for t in texts[:5]]
    got = spectrum.products(texts, spectrum.matrix(points))

    def places(piece):
        return {int(x) for x in spectrum.places(np.array([ord(c) for c in piece], dtype=np.uint32))}

    marks = [set(np.flatnonzero(np.unpackbits(np.frombuffer(p, np.uint8))).tolist()) for p in points]
    for text, row in zip(texts, got):
        clean = f" {text} "
        cut = [clean[i:i + 50] for i in range(0, len(clean), 50)]
        want = [sum(len(p) * len(places(p) & m) / (len(places(p)) * len(m)) ** 0.5 for p in cut) / len(clean)
                for m in marks]
        assert np.allclose(row, want, atol=1e-4)


def test_languages_of_nothing(spark):
    empty = languages.languages(frame(spark, [(1, "a", "en")]).where("false"))
    assert empty.count() == 0
    assert [r["lang_pred"] for r in languages.languages(frame(spark, [(1, "words", None)])).collect()] == ["und"]
    few = languages.languages(frame(spark, [(1, "words", "en"), (2, None, "en")])).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in few] == ["en", "und"]
