"""Spelling variants, source divergence and prefix token counts against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from navstead.llm import divergence, llm_queries, spelling, tokencounts
from navstead.llm.llm_queries import tokenizer_file

from .brute import LOWER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, root string, term string, value long, ids string"
CLASH = ("w", 3, "r", "t", 1, "i")  # columns named like results and helpers


def table(spark, rows):
    """(doc_id, text, lang, source) with the other columns of a documents table and clashing ones."""
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t), *CLASH) for d, t, la, s in rows], DOCS).repartition(3)


# --- spelling variants
def variants(docs, every=31, least=7, lead=10):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)):] == b[p + (len(b) >= len(a)):]

    out, form = {}, {}
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if near(w, v)]
        best = min(close, default=None)
        form[w] = best[1] if best and -best[0] >= lead * n else None
        out[w] = [n, len(close), form[w], counts[form[w]] if form[w] else None]
    for w in out:
        top = w
        while form[top]:
            top = form[top]
        out[w].append(top)
    return {w: tuple(v) for w, v in out.items()}


def spelling_texts(seed):
    rng = random.Random(seed)
    base = ["programme", "schönheit", "ÉCLAIRS", "aaaaaaa", "aaaaaaaa", "abababab", "category", "colourful", "ÿÿÿÿÿÿÿ"]
    letters = "abcdeéß"
    words = []
    for w in base:
        words += [w] * rng.choice([2, 30, 300])
        for _ in range(30):
            v, i = w, rng.randrange(len(w))
            for _ in range(rng.choice([1, 1, 2])):
                i = rng.randrange(len(v))
                v = rng.choice([v[:i] + rng.choice(letters) + v[i:], v[:i] + v[i + 1:], v[:i] + rng.choice(letters) + v[i + 1:]])
            words += [v] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    joins = [" ", ", ", "\n", "×", "1", "_"]
    texts = ["".join(w + rng.choice(joins[:3] + joins[4:]) for w in words[a:a + 40]) for a in range(0, len(words), 40)]
    return [*enumerate(texts), (None, texts[0]), (5, texts[0]), (5, texts[0]), (7, None), (8, ""), (9, "x" * 5000 + " " + "x" * 5000), (10, "short")]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_variants_match_brute_force(spark, seed):
    docs = spelling_texts(seed)
    words = spelling.word_counts(spelling.thinned(spelling.letter_runs(table(spark, [(d, t, "en", "s") for d, t in docs]), 7), 31), 7, 2)
    for parts in (4, 5):
        got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(words, parts=parts).collect()}
        assert got == variants(docs)
    assert any(v[2] for v in got.values())


def test_forms_are_followed_to_the_root(spark):
    chain = [("aaaaaaaaaa"[:10 - i] + "b" * i, 3 * 10**i) for i in range(7)]  # each leads to the next
    df = spark.createDataFrame([*chain, ("zzzzzzz", 5)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_variants(df).collect()}
    assert got == {**{w: (chain[i + 1][0] if i < 6 else None, chain[6][0]) for i, (w, _) in enumerate(chain)}, "zzzzzzz": (None, "zzzzzzz")}


def test_no_signature_misses_a_near_word(spark):
    """Every single edit of words over few letters, where multisets collide most."""
    rng = random.Random(3)
    words = {"".join(rng.choices("ab", k=rng.randint(7, 10))) for _ in range(120)} | {"".join(rng.choices("abcÿ", k=7)) for _ in range(60)}
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in spelling.near_pairs(df).collect()}

    def edits(w):
        for i in range(len(w) + 1):
            for c in "abcÿ":
                yield w[:i] + c + w[i:]
                if i < len(w):
                    yield w[:i] + c + w[i + 1:]
            if i < len(w):
                yield w[:i] + w[i + 1:]

    assert got == {(w, v) for w in words for v in edits(w) if v in words and v != w}


def test_spelling_of_nothing(spark):
    empty = table(spark, [(1, None, None, None), (2, "short words", "", "")])
    words = spelling.word_counts(spelling.thinned(spelling.letter_runs(empty, 7), 31), 7, 2)
    assert spelling.spelling_variants(words).count() == 0


# --- source divergence
def audit(docs, min_docs, top, scale=10**9):
    counts, holders, groups = defaultdict(Counter), defaultdict(set), set()
    for doc, text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text):
            term = term.translate(LOWER)
            counts[lang, source][term] += 1
            holders[lang, term].add(doc)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (la, t), d in holders.items() if la == lang and len(d) >= min_docs]
        sources, v = sorted(s for la, s in groups if la == lang), len(kept)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c, v=v, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + scale * (c[t] + 2) // (n + 2 * v) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows, last in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:last]
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)}
    return out


def divergence_docs(seed, n=90):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "THE,", "don't", "naïve", "日本語テキスト", "a1b2", "x-ray", "123", "ÀÉ", "end.", " gap ", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "ü", None])
        rows.append((i, rng.choice([" ", "\n", "\x0b", "\x1c"]).join(rng.choices(vocabulary, k=rng.randint(0, 12))), lang, source))
    return [*rows, (3, "the the zebra", "en", "s1"), (3, "the the zebra", "en", "s1"), (None, "zebra the", "en", "s0"), (None, "zebra", "en", "s1"), (500, None, "de", "only"), (501, "", "it", "a"),
            (502, "x", "it", "b"), (503, "don't-don't " * 3000, "en", "long")]


@pytest.mark.parametrize("held", [20, 1_500_000])
def test_source_divergence_matches_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD", held)
    for seed, min_docs in ((1, 3), (2, 10)):
        docs = divergence_docs(seed)
        got = divergence.source_divergence(table(spark, docs), min_docs=min_docs, top=4)
        rows = [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == audit(docs, min_docs, 4)


def test_source_divergence_of_nothing(spark):
    assert divergence.source_divergence(table(spark, []).where("false")).count() == 0


def test_shares_stay_exact_beyond_64_bits(spark):
    n, total, terms = 9_000_000_000_123, 77_000_000_000_456, 1_000_003
    row = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert row.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"), 10**9)).first()[0] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


# --- prefix token counts
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


COUNTED = [None, "", " ", "   ", "\n", "a", " a", "a ", "The quick brown fox", "  two  spaces  ", "tab\tand\r\nline ends\n\n", "<s></s><unk><0x41>", "日本語テキスト🙂 ÿ", "▁marks▁ ▁", "\x00 nul",
           "é ﬁ Å", "x" * 3000, " " * 1500, "0123456789abcdef" * 200, "ab\n" * 500]


def test_every_prefix_has_the_count_of_the_library(library):
    own = tokencounts.counter(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(4)
    texts = [t or "" for t in COUNTED] + ["".join(rng.choices("abcdefghe  \n▁\tXY01é日🙂<>s", k=rng.randint(1, 60))) for _ in range(150)]
    for text in texts:
        steps, total = own.prefixes(text)
        assert total == len(library.encode(text)) and len(steps) == len(text)
        count = 0
        for k, step in enumerate(steps[:400], 1):
            count += step - 256 * (step > 127)
            assert count == len(library.encode(text[:k])), text[:k]


def test_a_long_text_without_spaces_takes_time_in_proportion(library):
    import time

    own, rng = tokencounts.counter(tokenizer_file("piece_bpe_32k.model")), random.Random(5)
    for letters, k in (("abcdefghijklmnop", 1_000_000), ([chr(c) for c in range(0x4E00, 0x9F00)], 700_000)):
        text = "".join(rng.choices(letters, k=k))
        began = time.time()
        assert own.prefixes(text)[1] == len(library.encode(text))
        assert time.time() - began < 60


def test_counts_answer_cuts_and_budgets(spark, library):
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(COUNTED)] + [(None, "no id", None, None), (3, "again", None, None)])
    counts = tokencounts.prefix_counts(docs, tokenizer_file("piece_bpe_32k.model")).persist()
    got = {r.doc_id: r for r in counts.collect() if r.doc_id not in (None, 3)}
    for i, text in enumerate(COUNTED):
        if i != 3:
            assert (got[i].n_chars, got[i].n_bytes, got[i].n_tokens) == (len(text or ""), len((text or "").encode()), len(library.encode(text or "")))
    assert counts.count() == len(COUNTED) + 2
    for limit in (0, 1, 5, 40):
        for r in tokencounts.cut_points(counts.where("doc_id <> 3"), limit).collect():
            text = COUNTED[r.doc_id] or ""
            fits = [k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= limit] if len(text) < 100 else None
            assert r.kept_tokens == len(library.encode(text[:r.kept_chars])) <= limit
            assert fits is None or r.kept_chars == fits[-1]
    for r in tokencounts.tokens_at(counts.where("doc_id <> 3"), 7).collect():
        assert r.n_tokens == len(library.encode((COUNTED[r.doc_id] or "")[:7]))


# --- the registered queries over a small folder
def test_registered_queries_over_a_folder(spark, tmp_path, library):
    docs = [(d, t, "en" if i % 3 else None, f"s{i % 2}") for i, (d, t) in enumerate(spelling_texts(6)) if d is not None]
    docs += [(1000 + i, t, la, s) for i, (_, t, la, s) in enumerate(divergence_docs(6))] + [(2000 + i, t, "x", "y") for i, t in enumerate(COUNTED)]
    docs += [(3000, "a " * 4096 + "a", "x", "y"), (3001, "a " * 4095 + "a", "x", "y")]
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: llm_queries.QUERIES[name](spark, str(tmp_path)).collect()
    want = variants([(d, t) for d, t, _, _ in docs])
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in run("op11_spelling_variants")} == want
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in run("op12_source_divergence")} == audit(docs, 10, 10)
    counted = sorted(tuple(r) for r in run("op13_token_counts"))
    assert [r[2:] for r in counted if r[0] >= 3000] == [(4097, True), (4096, False)]
    assert counted == sorted((d, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for d, t, _, _ in docs)
