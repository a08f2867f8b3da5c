"""Queries on the smallest driver tables, against their SQL or a plain version."""

import hashlib
import zlib

import pytest

from inkwell.llm import queries as llm

from ..conftest import SF, same_rows
from .test_small_tables import brute_components, check_packing, rows


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, duck, name):
    same_rows(llm.queries()[name](spark, SF), duck.execute(llm.oracle_sql()[name]).df())


def test_components(spark, texts):
    from collections import Counter

    got = llm.queries()["op3_ngram_jaccard"](spark, SF).select("doc_id", "n_shingles", "component_id")
    assert Counter(rows(got)) == brute_components(list(texts.items()))


def test_packing_is_tight(spark, texts):
    packed = rows(llm.queries()["op7_best_fit_packing"](spark, SF))
    n, tokens = check_packing(packed, list(texts.items()))
    assert n <= 1.02 * tokens / 1024 + 1


def test_bpe(spark, texts):
    from .test_small_tables import reference_encoding

    plain = reference_encoding()
    for i, n, ids, decoded in rows(llm.queries()["op10_byte_bpe"](spark, SF)):
        expected = plain.encode_ordinary(texts[i])
        assert (n, ids, decoded) == (len(expected), hashlib.sha256(",".join(map(str, expected)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def test_languages(spark, duck):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = rows(llm.queries()["op6_language_id"](spark, SF))
    held = [(i, p) for i, h, p, _ in got if h]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h, *_ in got)
    assert sum(lang[i] == p for i, p in held) >= 0.95 * len(held)


def test_fingerprints(spark, texts):
    ids = sorted(texts)
    got = {r[0]: r[1:] for r in rows(llm.queries()["op4_document_fingerprints"](spark, SF))}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, h = texts[i], len(texts[i]) // 2
        assert got[i][:2] == (len(t), hashlib.sha256((t[: len(t) - h] + texts[j][:h]).encode()).hexdigest())
    likes = [got[i][4] for i in ids if len(texts[i]) > 1000]
    assert sum(likes) / len(likes) > 0.4 and all(0 <= v <= 1 for r in got.values() for v in r[4:6])


def test_licence_bases(spark, texts):
    import re

    for i, n, base, first, last, labels, all_labels, score in rows(llm.queries()["op5_license_scans"](spark, SF)):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))
        at = sorted((k, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert (n, base, first, last) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert labels == ",".join(sorted({x for _, x in at})) and set(filter(None, labels.split(","))) <= set(filter(None, all_labels.split(","))) and 0 <= score <= 1


def test_token_totals(spark, duck, texts):
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from .test_small_tables import reference_encoding

    single, multi = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), reference_encoding()
    counters = {"byte_bpe_50k@1": lambda t: len(single.encode(t, add_special_tokens=False).ids), "byte_bpe_multi_50k@1": lambda t: len(multi.encode_ordinary(t))}
    toxic = {i for (i,) in duck.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    expected = Counter()
    for i, t, s, g in duck.execute("SELECT doc_id, text, source, lang FROM documents").fetchall():
        if i not in toxic:
            for version, f in counters.items():
                trimmed = t.strip(" \t\n\x0b\f\r")
                expected[s, g, version, "docs"] += 1
                expected[s, g, version, "tokens"] += f(trimmed)
                expected[s, g, version, "chars"] += len(trimmed)
    got = Counter()
    for s, g, v, docs, tokens, chars in rows(llm.queries()["op2_token_counts"](spark, SF)):
        got[s, g, v, "docs"], got[s, g, v, "tokens"], got[s, g, v, "chars"] = docs, tokens, chars
    assert got == expected


def test_pipeline(spark, duck, texts):
    import corpus_pipeline

    from .test_small_tables import copies, shingles

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "best_fit_packing"]
    packed = rows(corpus_pipeline.run(spark, SF))
    lettered = {i: t for i, t in texts.items() if t and any(map(str.isalpha, t))}
    once = {min(ids) for ids in copies([(i, t) for i, t in lettered.items()]).values()}
    first = {c for _, n, c in brute_components([(i, lettered[i]) for i in once]) if n}
    expected = first | {i for i in once if not shingles(lettered[i])}
    assert {r[0] for r in packed} == expected
    check_packing(packed, [(i, texts[i]) for i in expected])
