"""Divergence, token counts and the manifest against brute force and on odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorestone.llm import divergence, postorder, pretokens

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "ß", "éa", "'s")]
    rows = [(i, rng.choice(["a", "b", "hot", "hot", "hot"]), rng.choice(["en", "de"]), i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30])))) for i in range(700)]
    rows += [(None, None, None, None, None), (None, "", "", 0, ""), (3, "a", "en", 3, "twice The same"), (3, "a", "en", 3, "twice The same"),
             (10_000, None, None, 1, "Null source"), (10_001, "lone", "fr", 1, None), (10_002, "long", "en", 1, "Very Long " * 60_000)]
    return spark.createDataFrame(rows, DOCS)


def brute_divergence(rows, least, shown):
    group, lang_docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source, text = r.lang or "", r.source or "", r.text or ""
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text)))
        group[lang, source].update(found)
        langs[lang].update(found)
        lang_docs[lang].update(found.keys())
    out = set()
    for (lang, source), own in group.items():
        kept = {t for t, n in lang_docs[lang].items() if n >= least}

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        mine, whole = p(own), p(langs[lang])
        pairs = []
        for (other_lang, other), theirs in group.items():
            if other_lang == lang and other != source:
                q = p(theirs)
                pairs.append((-sum((mine[t] - q[t]) ** 2 // (mine[t] + q[t]) for t in kept), other.encode(), other))
        terms = [(-((mine[t] - whole[t]) ** 2 // (mine[t] + whole[t])), t.encode(), t) for t in kept if own[t] and mine[t] > whole[t]]
        out |= {(lang, source, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pairs))}
        out |= {(lang, source, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(terms)[:shown])}
    return out


def test_divergence_equals_brute_force(spark, odd, monkeypatch):
    want = brute_divergence(odd.collect(), 10, 10)
    assert {tuple(r) for r in divergence.divergence(odd).collect()} == want
    # many small blocks of terms and sources, and tasks that send early
    monkeypatch.setattr(divergence, "TERMS", 3)
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "HELD", 5)
    clash = odd.withColumn("term", F.lit("x")).withColumn("n", F.lit(1))
    got = divergence.divergence(clash).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_divergence_of_empty_tables(spark, odd):
    assert divergence.divergence(odd.limit(0)).count() == 0
    alone = divergence.divergence(odd.where("source is null or source = ''")).collect()
    assert sorted((r.part, r.item, r.value) for r in alone) == []


def test_token_counts_equal_the_library(spark, odd):
    rng = random.Random(1)
    alphabet = "aB 1.,'\n\t\x1c\x00!<|>éÉßΣσİḰ中あ한👍ⅷ  ­ſ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 5, 40]))) for _ in range(400)]
    texts += ["a <|endoftext|>b", "<|ENDOFTEXT|>", "I'LL don't 's", "éa", "x" * 5000, " ".join(map(chr, range(1, 0x3000))), None, ""]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit(0)).withColumn("piece", F.lit(""))
    library = Tokenizer.from_file(VOCABULARY)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for most in (0, 8, pretokens.FREQUENT):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in pretokens.token_counts(frame, VOCABULARY, 20, most=most).collect()}
        assert got == {i: (b, n, n > 20) for i, (b, n) in want.items()}
    assert pretokens.token_counts(odd, VOCABULARY, 2048).where("over_limit").count() == 1
    assert pretokens.token_counts(frame.limit(0), VOCABULARY, 20).count() == 0


def test_the_frequent_table_is_bounded_and_the_cache_starts_anew(spark, odd, monkeypatch):
    table = pretokens.frequent(odd.select("text"), VOCABULARY, 5)
    assert len(table) == 5 and {"very", "long"} <= set(table)
    monkeypatch.setattr(pretokens, "CACHED", 3)
    lengths = pretokens.Lengths({}, pretokens.PreTokens(VOCABULARY))
    library = Tokenizer.from_file(VOCABULARY)
    text = "several different words make the cache start anew several times different"
    assert lengths.total(text) == len(library.encode(text).ids) and len(lengths.cache) <= 3


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 255, 256, 257, 272, 4096, 4097, 5000])
def test_positions_are_those_of_an_appending_writer(leaves):
    levels = postorder.height(leaves)
    seen = [0] * (levels + 1)
    for at, (level, _) in enumerate(postorder.appended([b"x"] * leaves, levels)):
        assert postorder.position(level, seen[level], leaves) == at
        seen[level] += 1
    assert seen[levels] == 1


def brute_manifest(rows, hit):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i: i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    sources = defaultdict(list)
    for r in rows:
        sources[(r.source is not None, (r.source or "").encode())].append(((r.doc_id is not None, r.doc_id or 0), leaf(r, r.text), r))
    trees = {s: climb([x[1] for x in sorted(found, key=lambda x: x[:2])]) for s, found in sources.items()}
    top = climb([trees[s][-1][0] for s in sorted(trees)])
    out = []
    for place, s in enumerate(sorted(trees)):
        for i, (_, digest, r) in enumerate(sorted(sources[s], key=lambda x: x[:2])):
            forged = leaf(r, "".join(c.lower() if c.isascii() else c for c in r.text) if r.text is not None else None) if hit(r.doc_id) else digest
            proof, folded = "", forged
            for levels, at in ((trees[s], i), (top, place)):
                for level in levels[:-1]:
                    low = at - at % 16
                    proof += "".join(level[low:at] + level[at + 1: low + 16])
                    folded = h("".join(level[low:at]) + folded + "".join(level[at + 1: low + 16]))
                    at //= 16
            out.append((r.doc_id or -1, digest, trees[s][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("built", [1, 2])
def test_manifest_equals_brute_force(spark, odd, built):
    many = odd.unionByName(odd.where("doc_id < 40").withColumn("source", F.concat(F.lit("s"), F.col("doc_id"))))
    frame = many.withColumn("rank", F.lit("x")).withColumn("grp", F.lit("y")).withColumn("leaf", F.lit(0))
    got = postorder.manifest(frame, tampered=F.col("doc_id") % 3 == 0, built=built).collect()
    want = brute_manifest(many.collect(), lambda i: i is not None and i % 3 == 0)
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == want
    assert any(r.verified for r in got) and not all(r.verified for r in got)


def test_manifest_of_small_tables(spark, odd):
    assert postorder.manifest(odd.limit(0)).count() == 0
    one = postorder.manifest(odd.where("doc_id = 10001")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].root == one[0].subroot and one[0].proof_sha256 == hashlib.sha256(b"").hexdigest()
