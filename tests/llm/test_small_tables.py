"""Every operator on awkward tables: nulls, empty and long texts, ties, repeated rows, no rows, extra columns."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from inkwell.llm import bpe, chat_format, exact_dedup, fingerprints, jaccard_join, langid, licenses, line_dedup, packing, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
ROWS = [
    (3, "one two three four five six seven eight nine ten\nalpha beta\ngamma delta\nMIT License", "en", "a", 1),
    (1, "one two three four five six seven eight nine ten\nalpha beta\ngamma delta\nMIT License", "en", "a", 1),
    (2, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " ", None, "b", 1),
    (6, LONG, "fr", "b", 5),
    (7, LONG + " tail", "fr", "b", 5),
    (7, LONG + " tail", "fr", "b", 5),
    (8, "12345 !!!", "en", "c", 1),
    (None, "no id here but words enough for a set of shingles", "de", "c", 1),
    (9, "ÀÉ ß 漢字 😀 mixed  spaces\t\n\nend ", "de", "c", 1),
    (10, "a b", "en", "a", 3),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The rows as files, with columns whose names an operator might use itself."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        df = spark.createDataFrame(rows, DOCS)
        extra = ("key", "maybe", "file", "row", "batch", "score", "lang_pred", "label", "n", "ids", "t", "p")
        df.selectExpr("*", *(f"'x' AS `{c}`" for c in extra)).coalesce(2).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="module")
def docs(table):
    return table(ROWS)


@pytest.fixture(scope="module")
def none(table):
    return table([])


def rows(df):
    return [tuple(r) for r in df.collect()]


def some(v):
    return v or ""


def key(i):
    return (i is None, i)


# -- exact copies ----------------------------------------------------------------------------------------------


def copies(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", some(t))].append(i)
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: exact_dedup.F.substring(exact_dedup.sha256(t), 1, 1)], ids=["sha256", "colliding"])
def test_exact_dedup(spark, docs, tmp_path, digest):
    d = exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/state", digest)
    d.add(docs)
    d.add(docs)  # the same batch again changes nothing
    got = rows(d.result({0: docs}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
    expected = Counter()
    for text, ids in copies(ROWS).items():
        ids.sort(key=key)
        for k, i in enumerate(ids):
            expected[i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(got) == expected


def test_exact_dedup_goes_on_from_its_state(spark, table, tmp_path):
    a, b = table([(5, "x", "", "", 0), (6, "y", "", "", 0)]), table([(1, "x", "", "", 0), (7, "z", "", "", 0)])
    d = exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/state")
    d.add(a, 0)
    d.add(b, 1)
    got = {r[0]: r[1:4] for r in rows(d.result({0: a, 1: b}).select("doc_id", "keep_id", "group_size", "kept"))}
    assert got == {5: (1, 2, False), 1: (1, 2, True), 6: (6, 1, True), 7: (7, 1, True)}


@pytest.mark.parametrize("first", [True, False], ids=["first batch", "second batch"])
@pytest.mark.parametrize("step", ["rename", "stream", "mark"])
def test_exact_dedup_goes_on_after_an_interruption(spark, table, tmp_path, monkeypatch, step, first):
    a, b = table([(5, "x", "", "", 0), (6, "y", "", "", 0)]), table([(1, "x", "", "", 0), (7, "z", "", "", 0)])
    d = exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/state")
    if not first:
        d.add(a, 0)
    with monkeypatch.context() as m:
        if step == "mark":  # the stream has run, its batch isn't marked
            run = exact_dedup.StreamingDedup._stream
            m.setattr(exact_dedup.StreamingDedup, "_stream", lambda self: (run(self), 1 / 0))
        else:
            m.setattr(exact_dedup.StreamingDedup, *(("_write", lambda *x: 1 / 0) if step == "rename" else ("_stream", lambda self: 1 / 0)))
        with pytest.raises(ZeroDivisionError):
            d.add(*((a, 0) if first else (b, 1)))
    d = exact_dedup.StreamingDedup(spark, f"file://{tmp_path}/state")  # a new driver
    d.add(a, 0)
    d.add(b, 1)
    got = {r[0]: r[1:4] for r in rows(d.result({0: a, 1: b}).select("doc_id", "keep_id", "group_size", "kept"))}
    assert got == {5: (1, 2, False), 1: (1, 2, True), 6: (6, 1, True), 7: (7, 1, True)}


def test_exact_dedup_stage_and_empty_table(spark, docs, none):
    kept = exact_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert kept.count() == len(copies(ROWS)) and exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")).filter("kept").count() == 1


# -- lines -----------------------------------------------------------------------------------------------------


def brute_lines(data):
    seen, out = set(), Counter()
    for i, t in sorted(data, key=lambda x: key(x[0])):
        ls = some(t).split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in ls]
        ends = [-1, *(k for k in range(len(ls)) if (h[k] + (31 * h[k - 1] if k else 0)) % 11 != 0 or k == len(ls) - 1)]
        gone = set()
        for before in ends:
            last = next((e for e in ends if e - before >= 2), None)
            if last is not None:
                chunk = "\n".join(ls[before + 1 : last + 1])
                if chunk in seen:
                    gone |= set(range(before + 1, last + 1))
                seen.add(chunk)
        out[i, len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)] += 1
    return out


@pytest.mark.parametrize("digest", [line_dedup.F.xxhash64, lambda t: line_dedup.F.length(t) % 5], ids=["xxhash64", "colliding"])
def test_line_dedup(table, none, digest):
    rng = np.random.default_rng(3)
    lines = [f"line {i} " + "ab " * (i % 5) for i in range(25)] + [""]
    passage = [lines[i] for i in rng.integers(0, 26, 12)]
    data = [(i, "\n".join([*(lines[k] for k in rng.integers(0, 26, rng.integers(0, 9))), *(passage if i % 2 else [])]), "en", "s", 0) for i in range(40)] + [r for r in ROWS if r[0] != 7]
    got = Counter(rows(line_dedup.line_dedup(table(data), digest)))
    assert got == brute_lines([(r[0], r[1]) for r in data])
    assert sum(n * r[2] for r, n in got.items()) > 0 and line_dedup.line_dedup(none).count() == 0


# -- similarity ------------------------------------------------------------------------------------------------


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), some(t))) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(data):
    sets = [shingles(t) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(data)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    smallest = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            smallest[find(i)] = min(d, smallest.get(find(i), d))
    return Counter((d, len(sets[i]), smallest.get(find(i))) for i, (d, _) in enumerate(data))


def near_copies(n, seed):
    """Texts in families: small edits at rates around the threshold, sizes of all bands, chains, and a shared passage."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = list(out[rng.integers(len(out))])
            for _ in range(rng.integers(0, max(2, len(w) // 25))):
                at = rng.integers(len(w))
                w[at : at + int(rng.integers(0, 2))] = [f"e{rng.integers(1000)}"]
        else:
            w = [f"v{x}" for x in rng.integers(0, 5000, int(2 ** rng.uniform(0, 9)))] + (passage if rng.random() < 0.5 else [])
        out.append(w)
    order = rng.permutation(n)
    return [(int(order[i]), " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("how", ["measured", "subsets", "deletions", "colliding keys"])
def test_jaccard_components(spark, table, how, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    data = near_copies(400, 5) + [(r[0] + 1000 if r[0] is not None else None, r[1]) for r in ROWS]
    plan = None
    if how in ("subsets", "deletions"):
        plan = {}
        for b in range(15):
            h = jaccard_join.most_different(b)
            twos = (h + 1) // 2
            plan[b] = (h + 1 + (h + 1) // 4, 0) if how == "subsets" or not twos else (twos + (h + 1) % 2, twos)
    got = Counter(rows(jaccard_join.jaccard_components(table([(i, t, "", "", 0) for i, t in data]), plan, key_bits=6 if how == "colliding keys" else 64).select("doc_id", "n_shingles", "component_id")))
    assert got == brute_components(data)


def test_runs_of_a_family_name_the_same_pivots():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    plan = {b: ((h := jaccard_join.most_different(b)) + 1 + (h + 1) // 4, 0) for b in range(10)}
    for family in (100, 200, 400):
        base = rng.integers(0, 2**63, 200, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(200) > 0.03], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(family)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        key, _ = jaccard_join.keys(np.concatenate(sets), at)
        sig, who = jaccard_join.signatures(np.concatenate(sets), at, plan)
        raw = jaccard_join.sketches(np.concatenate(sets), at)
        order = np.lexsort((key[who].view(np.int64), sig))
        sig, who = sig[order], who[order]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(sig.view(np.int64)), pa.array(np.zeros(len(sig), np.int64)), pa.array(key[who].view(np.int64)), pa.array(np.diff(at)[who]), pa.array([raw[i] for i in who], pa.binary())],
            names=["run", "block", "key", "n", "sketch"],
        )
        pairs = {(r["a"], r["b"]) for out in jaccard_join._pivots(iter([batch])) for r in out.to_pylist()}
        assert family - 1 <= len(pairs) <= 8 * family


def test_allocation_turns_to_deletions_where_frequent_shingles_meet():
    few, many = jaccard_join.allocate({6: (10**4, 90.0, 0.05)}), jaccard_join.allocate({6: (10**9, 90.0, 0.05)})
    assert few[6][1] == 0 and many[6][1] > 0


def test_jaccard_hot_signatures_bypass_their_bucket(table, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    base = [f"b{i}" for i in range(120)]
    data = [(i, " ".join([*base[:100], f"x{i}", *base[100:]])) for i in range(25)]
    got = Counter(rows(jaccard_join.jaccard_components(table([(i, t, "", "", 0) for i, t in data])).select("doc_id", "n_shingles", "component_id")))
    assert got == brute_components(data) and len({r[2] for r in got}) == 1


@pytest.mark.parametrize("block", [7, 4096])
def test_jaccard_links_are_all_counted(table, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    word = [f"b{i}" for i in range(120)]
    group = [(2000 + i, " ".join([*word[:60], f"x{i}", *word[60:]])) for i in range(30)]
    data = near_copies(250, 6) + group + group[:3] + [(r[0] + 1000 if r[0] is not None else None, r[1]) for r in ROWS] + [(None, group[0][1])]
    sets = [shingles(t) for _, t in data]
    links = [0] * len(data)
    for i, j in itertools.combinations(range(len(data)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            links[i], links[j] = links[i] + 1, links[j] + 1
    got = Counter(rows(jaccard_join.jaccard_components(table([(i, t, "", "", 0) for i, t in data])).select("doc_id", "n_shingles", "links")))
    assert got == Counter((d, len(x), n) for (d, _), x, n in zip(data, sets, links, strict=True)) and max(links) == 33


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(8)
    found = 0
    for _ in range(300):
        n = int(2 ** rng.uniform(0, 8))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        found += 1
        for two in (False, True):
            plan = {}
            for band in range(10):
                h = jaccard_join.most_different(band)
                twos = (h + 1) // 2 if two else 0
                plan[band] = (twos + (h + 1) % 2, twos) if twos else (h + 1 + (h + 1) // 4, 0)
            sig, who = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), plan)
            assert set(sig[who == 0]) & set(sig[who == 1])
    assert found > 100


def test_jaccard_stage_and_empty_table(spark, docs, none):
    out = jaccard_join.stage(spark, docs, "")
    assert out.columns == docs.columns
    left = Counter(r[0] for r in rows(out))
    assert left == Counter([1, 2, 4, 5, 6, 8, None, 9, 10])
    assert jaccard_join.jaccard_components(none).count() == 0 and jaccard_join.stage(spark, none, "").count() == 0


# -- fingerprints ----------------------------------------------------------------------------------------------


def scalar_chunks(t):
    out, start = [], 0
    while start < len(t):
        h, end = 0, len(t)
        for i in range(start, len(t)):
            h = ((h << 1) + int(fingerprints.GEAR[t[i]])) & 0xFFFFFFFF
            size = i + 1 - start
            if size >= fingerprints.LARGEST or size >= fingerprints.WINDOW and h >> (32 - (fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE)) == 0:
                end = i + 1
                break
        out.append((start, end))
        start = end
    return out


def test_chunks_match_a_scalar_scan():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 120, int(n), dtype=np.uint8)) for n in (0, 1, 31, 32, 33, 500, 3000)] + [b"a" * 1000, b""]
    who, start, end = fingerprints.chunks(texts)
    base = 0
    for i, t in enumerate(texts):
        assert [(s - base, e - base) for w, s, e in zip(who, start, end, strict=True) if w == i] == scalar_chunks(t)
        base += len(t)


def test_fingerprints_resist_shifts():
    rng = np.random.default_rng(2)
    a = bytes(rng.integers(97, 120, 6000, dtype=np.uint8))
    sets = [fingerprints.digest_sets([x]) for x in (a, b"shifted by some bytes " + a, bytes(rng.integers(97, 120, 6000, dtype=np.uint8)))]
    assert fingerprints.containment(sets[0], sets[1])[0] > 0.97 and fingerprints.containment(sets[0], sets[2])[0] == 0
    both = fingerprints.containment(fingerprints.digest_sets([b"", b"x", a]), fingerprints.digest_sets([b"", b"", a]))
    assert both.tolist() == [1, 0, 1]


def plain_likeness(a, b):
    """Share of the length of a's distinct chunks that b has too, by the chunks' bytes."""
    a, b = ({t[s:e] for s, e in scalar_chunks(t)} for t in (a.encode(), b.encode()))
    return sum(map(len, a & b)) / sum(map(len, a)) if a else float(not b)


def test_fingerprints_of_null_and_repeated_ids(table):
    data = [(None, "no id " * 40, "", "", 0), (1, "b " * 90, "", "", 0), (1, "a " * 90, "", "", 0), (1, "a " * 90, "", "", 0), (None, None, "", "", 0), (2, "tail", "", "", 0)]
    got = rows(fingerprints.with_next(table(data), 3).mapInArrow(fingerprints._compare, fingerprints._OUT))
    assert Counter(r[0] for r in got) == Counter(r[0] for r in data)
    assert len({r[3] for r in got if r[0] == 1}) == 2 and len({r[3] for r in got if r[0] is None}) == 2


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_each_document_meets_the_next(table, buckets):
    data = [r for r in ROWS if r[0] is not None]
    got = rows(fingerprints.with_next(table(data), buckets).mapInArrow(fingerprints._compare, fingerprints._OUT))
    texts = [(i, some(t)) for i, t in sorted(((r[0], r[1]) for r in data), key=lambda r: r[0])]
    expected = Counter()
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1], strict=True):
        h = len(t) // 2
        expected[i, len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()] += 1
    assert Counter(r[:3] for r in got) == expected
    near = {}
    for (i, t), (_, n) in zip(texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        near.setdefault(i, []).append((plain_likeness(t, edited), plain_likeness(t, n)))
    for i, *_, edited, following in got:
        assert any(abs(a - edited) < 1e-9 and abs(b - following) < 1e-9 for a, b in near[i])
    prints = {i: f for i, _, _, f, *_ in got}
    assert prints[1] == prints[3] and prints[2] == prints[4] == ""


def test_fingerprints_of_one_and_no_row(table, none):
    one = rows(fingerprints.with_next(table(ROWS[:1]), 4).mapInArrow(fingerprints._compare, fingerprints._OUT))
    assert len(one) == 1 and one[0][6] == 1.0
    assert fingerprints.with_next(none, 4).mapInArrow(fingerprints._compare, fingerprints._OUT).count() == 0
    assert dict(rows(fingerprints.fingerprint(table(ROWS[:4]))))[2] == ""


# -- licences --------------------------------------------------------------------------------------------------


def test_licences(table, none):
    data = [
        (1, "Released under the mit   LICENSE. mit-license", "", "", 0),
        (2, "permission is HEREBY granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "", "", 0),
        (3, "Licensed under CC BY-NC 4.0.", "", "", 0),
        (4, "the driver has a license and the word apache stands apart from it", "", "", 0),
        (5, None, "", "", 0),
        (6, "xx This work is licensed under the GNU General Public License, version 3. apache license", "", "", 0),
        (7, "é license mité license", "", "", 0),
    ]
    got = {r[0]: r[1:] for r in rows(licenses.scan_licences(table(data)))}
    assert got[1] == (7, 2, 3, 5, "mit", "mit", 1.0) and got[2][4:6] == ("", "mit") and got[3][4:6] == ("", "cc-by-nc")
    assert got[4][1:] == (0, None, None, "", "", 0.0) and got[5] == (0, 0, None, None, "", "", 0.0)
    assert got[6][4:6] == ("apache,gpl", "apache,gpl") and got[7][4] == ""
    assert licenses.scan_licences(none).count() == 0


def plain_licences(texts):
    """Labels and score of each text by trying every template at every place."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), some(t)))
    out = []
    for t in texts:
        words, found = word(t), []
        for label, template, phrases in licenses.TEMPLATES:
            template = word(template)
            for first in range(1 - len(template), len(words)):
                span = words[max(first, 0) : first + len(template)]
                share = sum(k + first >= 0 and k + first < len(words) and words[k + first] == w for k, w in enumerate(template)) / len(template)
                if share >= licenses.LEAST_SHARE and all(f" {' '.join(word(p))} " in f" {' '.join(span)} " for p in phrases):
                    found.append((label, share))
        base = [label for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {' '.join(words)} "]
        out.append((",".join(sorted({*base, *(x for x, _ in found)})), max([float(bool(base)), *(s for _, s in found)])))
    return out


def test_licences_match_a_scan_of_all_places(table):
    rng = np.random.default_rng(7)
    texts = []
    for i in range(150):
        words = [w for k in rng.integers(0, len(licenses.TEMPLATES), rng.integers(1, 4)) for w in ["xx", *licenses.TEMPLATES[k][1].split()]]
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 2))] = [["software", "license", "zz", ""][rng.integers(0, 4)]]
        texts.append(" ".join(words[rng.integers(0, 3) :]))
    got = {r[0]: r[1:] for r in rows(licenses.scan_licences(table([(i, t, "", "", 0) for i, t in enumerate(texts)])).select("doc_id", "labels", "score"))}
    for i, (labels, score) in enumerate(plain_licences(texts)):
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-12, texts[i]


def test_licence_places_match_a_regular_expression():
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for _, t, *_ in ROWS:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), some(t))
        assert [w.decode() for w in licenses.words_of(some(t).encode())] == word.findall(low)


@pytest.mark.parametrize("common", [False, True], ids=["unseen words", "common words"])
def test_every_licence_of_a_file_is_found(common):
    index = licenses.LicenceIndex()
    if common:
        index.weighted({w: 7 * k % 90 for k, w in enumerate(index.vocabulary)}, 100)
    parts = [(label, licenses.words_of(t.encode())) for label, t, _ in licenses.TEMPLATES]
    for (a, x), (b, y) in itertools.permutations(parts, 2):
        assert {a, b} <= {label for label, _ in index.scan([*x, b"between", *y])}
    assert {a for a, _ in parts} == {label for label, _ in index.scan([w for _, x in parts for w in x])}
    for label, x in parts:  # as many words replaced as a finding may miss, its own phrases apart
        phrases = {w for (_, t, p) in index.templates if t == x for q in p for w in q}
        free = [k for k, w in enumerate(x) if w not in phrases][: sum(k / len(x) >= licenses.LEAST_SHARE for k in range(len(x)))]
        assert label in {f for f, _ in index.scan([b"-" if k in free else w for k, w in enumerate(x)])}


# -- languages -------------------------------------------------------------------------------------------------


def test_language_id(spark, table, none):
    words = {"en": "the of and in is that it was".split(), "de": "der die und ist nicht ein ich über".split()}
    rng = np.random.default_rng(4)
    data = [(i, " ".join(rng.choice(words[g], 20)), g, "", 0) for i, g in enumerate(rng.choice(["en", "de"], 200).tolist())]
    train = table(data[:100])
    model = langid.train(train.select("text", "lang"))
    assert model[0] == ["de", "en"]
    got = {r[0]: r[1:] for r in rows(langid.predict(table(data[100:] + [(900, None, "en", "", 0), (901, "12 !", None, "", 0), (902, "", "", "", 0)]), model, ["doc_id"]))}
    assert all(got[i][0] == g for i, _, g, *_ in data[100:]) and all(0 <= s <= 1 for _, s in got.values())
    assert [got[k] for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert set(r[1] for r in rows(langid.predict(train, langid.train(none.select("text", "lang")), ["doc_id"]))) == {"und"}
    out = langid.stage(spark, table(data + [(900, None, "en", "", 0)]), "")
    assert out.count() == 200 and "score" in out.columns
    small = langid.train(train.select("text", "lang"), rows=20)
    assert small[0] == ["de", "en"]


def test_rare_languages_and_copies_are_sampled_alike(table):
    rng = np.random.default_rng(9)
    data = [(i, "one and the same text" if i % 3 else " ".join(rng.choice(["ab", "cd", "ef", "gh"], 9)), "en", "", 0) for i in range(6000)]
    data += [(6000 + i, f"rare words {i}", "xx", "", 0) for i in range(3)]
    docs = table(data).select("doc_id", "text", "lang")
    assert langid.train(docs, rows=200)[0] == ["en", "xx"]
    got = rows(langid.sample(docs, 200, langid.label_counts(docs)))
    same = sum(t == "one and the same text" for t, _ in got)
    assert 140 <= len(got) <= 260 and 0.5 * len(got) < same < 0.8 * len(got)


def test_language_scores_match_a_plain_sum():
    texts = ["Ab1", "é", "x" * 50]
    ((who, parts, own),) = langid._steps(texts)
    grams, at = langid._grams(parts, own)
    assert who == [0, 1, 2] and np.diff(at).tolist() == [3 * (len(t) + 2) - 3 for t in texts]
    one, _ = langid._grams(parts[:1], own[:1])
    assert one.tolist() == grams[: at[1]].tolist()


@pytest.mark.parametrize("part", [3, 7, 64])
def test_long_texts_are_taken_in_parts(monkeypatch, part):
    texts = ["", "ab", "İstanbul und Köln " * 9, "x" * 64, "abcdefg"]

    def counts():
        out = [Counter() for _ in texts]
        for who, parts, own in langid._steps(texts, 50):
            grams, at = langid._grams(parts, own)
            for i, lo, hi in zip(who, at[:-1], at[1:], strict=True):
                out[i].update(grams[lo:hi].tolist())
        return out

    whole = counts()
    monkeypatch.setattr(langid, "PART", part)
    assert counts() == whole


def test_language_priors_decide_between_equal_texts(table):
    data = [(i, "same words", "en" if i % 4 else "de", "", 0) for i in range(40)]
    docs = table(data)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    assert np.exp(model[2]).round(6).tolist() == [0.25, 0.75]
    assert {r[1] for r in rows(langid.predict(docs, model, ["doc_id"]))} == {"en"}


# -- packing ---------------------------------------------------------------------------------------------------


def check_packing(packed, data, length=packing.LENGTH):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    sequences = defaultdict(list)
    docs = defaultdict(list)
    for i, piece, start, n, crc, seq, offset in packed:
        sequences[seq].append((offset, n))
        docs[i].append((piece, start, n, crc))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= length
    for i, text in data:
        ids = np.array([*t.encode(some(text), add_special_tokens=False).ids, 2], "<u4")
        import zlib

        parts = sorted(docs[i])
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids)
        assert all(n == length for _, _, n, _ in parts[1:])
        for _, start, n, crc in parts:
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    return len(sequences), sum(p[2] for d in docs.values() for p in d)


def test_packing(table, none):
    special = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|>  z <|endoftext", " <|endoftext|> "]
    data = [r for r in ROWS if r[0] not in (7, None)] + [(50 + i, t, "", "", 0) for i, t in enumerate(special)]
    check_packing(rows(packing.pack_documents(table(data))), [(r[0], r[1]) for r in data])
    assert packing.pack_documents(none).count() == 0
    # rows with one id, and rows without one, are packed each on its own
    packed = rows(packing.pack_documents(table(ROWS)))
    check_packing([(next(x), *r[1:]) if r[0] in (7, None) else r for x in [itertools.count(-1, -1)] for r in packed], [(r[0], r[1]) for r in ROWS if r[0] not in (7, None)])
    whole = Counter((r[0], r[4]) for r in packed if r[0] in (7, None))
    assert all(n == (2 if i == 7 else 1) for (i, _), n in whole.items()) and {i for i, _ in whole} == {7, None}


def test_packing_does_not_depend_on_batches(spark, monkeypatch):
    pieces = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", "CAST(0 AS int) AS piece", "0L AS start", "1 + (id * 7919) % 1024 AS length", "0L AS ids_crc32")
    got = set()
    for most in ("300", "2000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        got.add(frozenset(rows(packing.pack(pieces).select("doc_id", "sequence_id", "offset"))))
    assert len(got) == 1


def test_best_fit_bound():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 1025, 5000).tolist()
    b = packing.BestFit(1024, 64)
    placed = [b.place(n) for n in sizes]
    assert b.next <= 1.06 * sum(sizes) / 1024 and b.open <= 64
    assert packing.BestFit(10, 1).place(10) == (0, 0)
    tight = packing.BestFit(10, 5)
    assert [tight.place(n) for n in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    del placed


# -- chats -----------------------------------------------------------------------------------------------------


def test_chats(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "# <b> \\ é"), (1, 2, "tool", None), (2, 1, "assistant", "second"), (2, 0, "assistant", "first </turn>\n### user:\n"),
        (3, 0, None, ""), (None, 0, "user", "x"), (4, 0, "a:b\n", "\\"), (4, 0, "assistant", "tie"), (5, 0, "user", "z" * 100_000),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss")
    formatted = chat_format.format_chats(df)
    got = {r[0]: r[1:] for r in rows(formatted)}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[c].append((t, some(r), some(x)))
    for c, expected in by.items():
        expected.sort()
        n, text, loss = got[c]
        assert n == len(expected) and chat_format.parse(text) == [(r, x) for _, r, x in expected]
        assert "".join(chat_format.unescape(text[s["start"] : s["start"] + s["length"]]) for s in loss) == "".join(x for _, r, x in expected if r == "assistant")
    assert got[2][1] == "### assistant:\nfirst \\</turn>\n\\#\\#\\# user:\n</turn>\n### assistant:\nsecond</turn>\n"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_chats(empty)).count() == 0


def test_chats_that_cross_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(40).selectExpr("id div 7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('y', 20) AS text")
        assert sorted((r[0], r[1]) for r in rows(chat_format.format_chats(df))) == [(i, 7) for i in range(5)] + [(5, 5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# -- byte-level BPE --------------------------------------------------------------------------------------------


def reference_encoding():
    import tiktoken

    ranks, pattern = bpe.default_ranks()
    return tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=bpe.codec(ranks, pattern).ranks, special_tokens={})


@pytest.mark.parametrize("leaf", [(16, 8), (4096, 256)])
def test_bpe_trees(monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf[0])
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf[1])
    tree, plain = bpe.codec(*bpe.default_ranks()), reference_encoding()
    rng = np.random.default_rng(9)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "'", "'re", "'s", "1", "23", "漢", "字", "!", "...", "\t", "the", "ing", " ", "😀", "\x1c", "\0", "aaaa"]
    for k in range(600):
        text = "".join(rng.choice(alphabet if k % 3 else ["ab", "the", "x"], int(rng.integers(0, 150))).tolist())
        ids = tree.encode(text).tolist()
        assert ids == plain.encode_ordinary(text) and tree.decode(ids) == text.encode()


def test_bpe_long_match():
    tree, plain = bpe.codec(*bpe.default_ranks()), reference_encoding()
    for text in ("ab" * 20_000, "a" * 30_000, "z" * 5000 + " " + "漢" * 5000, LONG):
        assert tree.encode(text).tolist() == plain.encode_ordinary(text)


def test_bpe_tables(docs, none):
    at = bpe.default_ranks()
    plain = reference_encoding()
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text", "key"), *at), *at)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in out.collect()) == Counter((r[0], tuple(plain.encode_ordinary(some(r[1]))), some(r[1]).encode()) for r in ROWS)
    assert bpe.decode(bpe.encode(none.select("doc_id", "text"), *at), *at).count() == 0


# -- token counts ----------------------------------------------------------------------------------------------

CHANGES = "doc_id long, op string, seq long, source string, lang string, text string"


def test_rollup(spark, tmp_path):
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    count = token_counts.counters()

    def change(*rows_):
        return spark.createDataFrame(list(rows_), CHANGES)

    batches = [
        change((1, "insert", 1, "a", "en", "one two"), (2, "insert", 1, "a", None, None), (3, "insert", 1, None, "de", "drei"), (1, "insert", 2, "a", "en", "one two three")),
        change((1, "revise", 1, "b", "en", "moved"), (3, "delete", 1, None, None, None), (9, "delete", 1, "x", "x", "unknown"), (4, "insert", 1, "a", "en", "x y")),
        change((4, "insert", 1, "a", "en", "x y z")),
    ]
    for n, b in enumerate(batches):
        assert r.commit(n, b)
    before = sorted(rows(r.totals()), key=str)
    assert not r.commit(1, batches[1]) and sorted(rows(r.totals()), key=str) == before
    final = {1: ("b", "en", "moved"), 2: ("a", None, ""), 4: ("a", "en", "x y z")}
    expected = Counter()
    for version, f in count.items():
        groups = defaultdict(list)
        for s, g, t in final.values():
            groups[s, g].append(t)
        for (s, g), texts in groups.items():
            expected[s, g, version, len(texts), sum(map(f, texts)), sum(map(len, texts))] += 1
    assert Counter(before) == expected
    r.commit(7, spark.createDataFrame([], CHANGES))
    assert sorted(rows(r.totals()), key=str) == before
    with pytest.raises(ValueError, match="after batch 7"):
        r.commit(5, batches[0])


def test_rollup_counts_each_row_without_an_id(spark, tmp_path):
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    r.commit(1, spark.createDataFrame([(None, "insert", 1, "a", "en", "one"), (None, "insert", 1, "a", "en", "one"), (1, "insert", 1, "a", "en", "one")], CHANGES))
    r.commit(2, spark.createDataFrame([(None, "delete", 1, "a", "en", ""), (None, "revise", 1, "a", "en", "x y z"), (1, "delete", 1, "a", "en", "")], CHANGES))
    assert {x[3:6] for x in rows(r.totals())} == {(2, 2, 6)}


def test_rollup_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT", 2)
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    for n, (op, text) in enumerate([("insert", "a"), ("revise", "a b"), ("revise", "a b c"), ("delete", ""), ("insert", "a b"), ("revise", "a b c d")]):
        r.commit(n, spark.createDataFrame([(1, op, 1, "a", "en", text), (10 + n, "insert", 1, "a", "en", "x")], CHANGES))
    assert {x[3:6] for x in rows(r.totals())} == {(7, 10, 13)}
    assert r._numbers("compacted")[-1] == 5 and not r._numbers("state")


def test_interrupted_batch_is_written_again(spark, tmp_path):
    r = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    df = spark.createDataFrame([(1, "insert", 1, "a", "en", "one two")], CHANGES)
    r.commit(1, df)
    import shutil

    shutil.rmtree(tmp_path / "rollup" / "done")
    assert r.totals().count() == 0
    assert r.commit(1, df) and {x[3] for x in rows(r.totals())} == {1}
