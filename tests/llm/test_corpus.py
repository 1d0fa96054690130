"""Operators over the corpus: near-duplicates, substrings, quality rules, mixing, packing, pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairsight.llm import common, components, mixing, near_dedup, packing, quality_rules, substring_dedup

from .conftest import CLASH, ODD

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def pairs_of(odd):
    return [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(odd)]


# ---- near duplicates --------------------------------------------------------------------------------


def brute_groups(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(rng, n, words=60, start=0):
    """Texts around the threshold: one text with a varying number of changed words, and strangers."""
    base = [f"w{rng.integers(500)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base) if i % 3 else [f"v{rng.integers(500)}" for _ in range(words)]
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(words))] = f"x{rng.integers(9999)}"
        if i % 7 == 0:
            w = w[: words - int(rng.integers(0, 20))]
        out.append((start + i, " ".join(w).title() if i % 4 == 0 else "\t".join(w)))
    return out


@pytest.mark.parametrize("block", [300_000, 400])
def test_near_duplicates_equal_brute_force(make, block):
    """Also where clusters are dealt into blocks."""
    rng = np.random.default_rng(9)
    rows = family(rng, 90) + family(rng, 30, 12, 200) + [(500, ""), (501, None), (502, "one"), (503, "One"), (504, "one two"), (505, "one two three four")]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    want = brute_groups(rows, 4)
    got = near_dedup.near_duplicates(make(rows), near_dedup.Settings(words=4, block=block)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def crowded(rng):
    """Texts that share long passages below the limit, and near copies of them at and above it."""
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = shared[: int(rng.integers(30, 60))] + [f"u{i}x{j}" for j in range(int(rng.integers(10, 40)))]
        rows.append(w)
        for _ in range(int(rng.integers(0, 3))):
            c = list(w)
            for _ in range(int(rng.integers(0, 4))):
                c[int(rng.integers(len(c)))] = f"e{rng.integers(10**6)}"
            rows.append(c)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("region", [16, 2])
def test_forest_finds_all_groups_in_crowded_regions(make, region):
    rows = crowded(np.random.default_rng(8))
    got = near_dedup.near_duplicates(make(rows), near_dedup.Settings(words=4, region=region)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 4)


def test_links_come_from_the_forest(make, monkeypatch):
    rows = crowded(np.random.default_rng(8))
    whole = near_dedup.forest
    monkeypatch.setattr(near_dedup, "forest", lambda reps: whole(reps).limit(0))
    got = near_dedup.near_duplicates(make(rows), near_dedup.Settings(words=4)).collect()
    assert len({r["component_id"] for r in got}) > len({c for _, c in brute_groups(rows, 4).values()})


def test_near_duplicates_of_odd_rows(make):
    got = near_dedup.near_duplicates(make(ODD, **CLASH)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[6] == {(1, 6, True)} or by[6] == {(next(iter(by[6]))[0], 6, True)}
    assert all(c == 6 for _, c, _ in by[7]) and by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)}
    assert all(not kept for _, _, kept in by[None])
    assert near_dedup.near_duplicates(make([])).count() == 0


def test_resolve_keeps_a_single_bridge():
    """Two tight groups that only one pair links."""
    rng = np.random.default_rng(3)
    a, b = (np.sort(rng.integers(0, 2**62, 100).astype(np.uint64)) for _ in range(2))
    sets = [a] * 3 + [b] * 3
    bridge = np.sort(np.concatenate([a[:90], b[:10]]))
    other = np.sort(np.concatenate([a[:82], b[:18]]))
    sets = [*sets, bridge, other]
    got = near_dedup.resolve(np.arange(8), sets, near_dedup.Settings())
    assert got.tolist() == [0, 0, 0, 3, 3, 3, 0, 0]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["id"]: r["root"] for r in got.collect()} == {x: find(x) for x in parent}


# ---- substrings ---------------------------------------------------------------------------------------


def brute_removed(rows, window):
    words = [WORDS.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_repeated_passages_equal_brute_force(make):
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(60):
        w = [f"u{rng.integers(10**6)}" for _ in range(int(rng.integers(5, 120)))]
        if i % 3 == 0:
            cut = passage[int(rng.integers(0, 10)) : 50 - int(rng.integers(0, 8))]
            at = int(rng.integers(len(w)))
            w[at:at] = cut
        if i % 10 == 0:
            w += ["to"] * int(rng.integers(30, 60))
        rows.append((i, "\n".join([" ".join(w[:20]), "  ".join(w[20:])])))
    rows += [(100, " ".join(passage[:35])), (101, " ".join(passage[:34])), (102, rows[3][1]), (103, None), (104, "")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(make(rows)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_removed(rows, 35), strict=True))


def test_repeated_passages_of_odd_rows(make):
    out = substring_dedup.remove_repeated(make(ODD, **CLASH)).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[4]["n_removed"] == by[4]["n_words"] == 40_000 and by[4]["kept_text"] == ""
    assert substring_dedup.remove_repeated(make([])).count() == 0


@pytest.mark.parametrize("shard_words", [60_000, 40])
def test_repeated_windows_of_mixed_spans(make, shard_words):
    """Few words in near-equal texts: minimizers have many different spans, in and beyond a shard's bound."""
    rng = np.random.default_rng(4)
    base = [list(rng.choice(list("abcde"), 60)) for _ in range(3)]
    rows = []
    for i in range(40):
        w = list(base[i % 3])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = str(rng.choice(list("abcde")))
        rows.append((i, " ".join(w)))
    rows += [(50, " ".join(["x"] * 30)), (51, "a b " * 25)]
    s = substring_dedup.Settings(window=9, gram=3, shard_words=shard_words)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(make(rows), s).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_removed(rows, 9), strict=True))


def test_words_repeated_without_end_are_few_spans(make):
    rng = np.random.default_rng(6)
    rows = []
    for i, period in enumerate([1, 2, 3, 7, 28, 29, 34, 35, 36, 80] * 2):
        turn = [f"t{period}x{k}" for k in range(period)]
        w = turn * int(rng.integers(1, 9)) + turn[: int(rng.integers(0, period))]
        rows.append((i, " ".join([f"h{i}a", f"h{i}b", *w, f"e{i}"])))
    rows += [(50, "w " * 34), (51, "v " * 35), (52, "y " * 36)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(make(rows)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_removed(rows, 35), strict=True))
    for period in (1, 2, 28):
        text = " ".join(f"t{k % period}" for k in range(5000)).encode()
        spans = substring_dedup.Spans(common.Words([b"", text, b"a b", text]), substring_dedup.Settings())
        assert len(spans.at) < 10 and (spans.n * spans.times).sum() == 2 * (5000 - 34)


def test_repeated_passages_of_shared_and_null_ids(make):
    passage = " ".join(f"p{i}" for i in range(50))
    only_null = " ".join(f"q{i}" for i in range(40))
    rows = [(1, f"head head {passage}"), (1, f"{passage} tail"), (2, only_null), (None, only_null), (None, "unique words"), (3, only_null + " z"), (3, only_null + " z")]
    rows += [(4, " ".join(f"v{i}" for i in range(40)))]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeated(make(rows)).collect())
    assert got == sorted((i or -1, *facts) for (i, _), facts in zip(rows, brute_removed(rows, 35), strict=True))


def test_tokens_of_equal_polynomials(make):
    """Words whose polynomial hashes cancel out, and a table too small for what comes."""
    bits = [0]
    for _ in range(10):
        bits += [1 - x for x in bits]
    a, b = bytes(97 + x for x in bits), bytes(98 - x for x in bits)
    tokens = packing.Tokens(None)
    for t, got in zip([a, b], tokens.encode([a, b]), strict=True):
        assert got.tolist() == tokens.tokenizer.encode(t.decode(), add_special_tokens=False).ids
    tokens.SLOTS = 256
    tokens.clear()
    for k in range(8):
        texts = [" ".join(f"w{i * 37 % 101}x{k}" for i in range(j, j + 30)).encode() for j in (0, 20)]
        for t, got in zip(texts, tokens.encode(texts), strict=True):
            assert got.tolist() == tokens.tokenizer.encode(t.decode(), add_special_tokens=False).ids


def test_packing_of_a_very_long_filling(make):
    """A filling of many segments and buckets: every id in one piece, sequences gapless."""
    s = packing.Settings(filler=1)
    rows = packing.pack(make(["alpha beta gamma delta " * 60_000, "short text", None]), s).collect()
    by, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    tokens = packing.Tokens(None)
    for i, t in [(0, "alpha beta gamma delta " * 60_000), (1, "short text"), (2, "")]:
        ids = np.append(tokens.encode([t.encode()])[0], np.uint32(1)).astype("<u4")
        at = 0
        for start, length, total, crc in sorted(by[i]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[at : at + length].tobytes()))
            at += length
        assert at == len(ids)
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_hashes_tell_thue_morse_words_apart():
    bits = [0]
    for _ in range(11):
        bits += [1 - x for x in bits]
    a, b = bytes(97 + x for x in bits), bytes(98 - x for x in bits)
    for n in (8, 16, 32, 64, 128, 1024, 2048):
        h = common.Words([a[:n], b[:n]]).hashes()
        assert h[0] != h[1]
        codes = np.array([3, 5], np.uint64)
        assert common.windows(codes[bits[:n]], n)[0] != common.windows(codes[[1 - x for x in bits[:n]]], n)[0]


def test_automata_match_brute_force(make):
    rng = np.random.default_rng(2)
    reference = [" ".join(rng.choice(list("abcd"), 60)) for _ in range(4)]
    texts = [" ".join(rng.choice(list("abcd"), 80)) for _ in range(20)] + [reference[1], None, ""]
    s = substring_dedup.Settings(window=5)
    known = {tuple(w[k : k + 5]) for r in reference for w in [r.split()] for k in range(len(w) - 4)}
    got = {r["doc_id"]: r for r in substring_dedup.remove_known(make(texts), reference, s, shard_words=70).collect()}
    for i, t in enumerate(texts):
        w, gone = WORDS.findall(t or ""), set()
        for k in range(len(w) - 4):
            if tuple(w[k : k + 5]) in known:
                gone.update(range(k, k + 5))
        assert got[i]["n_removed"] == len(gone) and got[i]["kept_text"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    with pytest.raises(ValueError):
        substring_dedup.remove_known(make(texts), reference, s, bound=10)


# ---- quality rules ------------------------------------------------------------------------------------


def test_statistics_equal_brute_force(make):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "bb", "c#", "d|", "é"], int(rng.integers(0, 60)))) + "\n" * int(rng.integers(0, 3)) + "line\n \nline" for _ in range(60)] + [t for _, t in pairs_of(ODD) if t is None or len(t) < 10_000]
    got = {r["id"]: r for r in quality_rules.statistics(make(texts, **CLASH)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORDS.findall(t)
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_outliers_go_and_ordinary_texts_stay(make):
    rng = np.random.default_rng(6)
    words = lambda n, mark="": " ".join("".join(rng.choice(list("abcdefg"), int(rng.integers(2, 8)))) + mark for _ in range(n))
    texts = [words(int(rng.integers(30, 200))) for _ in range(300)] + [words(100, "###") for _ in range(20)] + ["few words"]
    out = {r["doc_id"]: r for r in quality_rules.judge(make(texts)).collect()}
    assert all(out[i]["kept"] for i in range(300)) and not any(out[i]["kept"] for i in range(300, 321))
    assert out[320]["base_failed"] and not out[310]["base_failed"]


def test_lines_repeated_below_the_base_limit_are_outliers_and_partitions_do_not_matter(make):
    rng = np.random.default_rng(6)
    line = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9)))) for _ in range(n))
    texts = []
    for _ in range(150):
        lines = [line(int(rng.integers(8, 16))) for _ in range(12)]
        if len(texts) % 50 == 7:
            short = line(3)
            lines = lines[:8] + [short] * 8  # half the lines are copies; few of the words
        texts.append("\n".join(lines))
    docs = make(texts)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs.repartition(3)).collect()}
    odd = [i for i in got if i % 50 == 7]
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in odd)
    assert sum(r["kept"] for i, r in got.items() if i not in odd) >= 145
    again = {r["doc_id"]: r for r in quality_rules.judge(docs.repartition(11)).collect()}
    assert all(got[i]["kept"] == again[i]["kept"] and abs(got[i]["distance"] - again[i]["distance"]) < 1e-6 for i in got)


def test_quality_rules_of_odd_rows_and_native_plan(make):
    docs = make(ODD, **CLASH)
    out = quality_rules.judge(docs)
    assert out.count() == len(ODD) and quality_rules.judge(make([])).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString() + quality_rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chi_square():
    assert quality_rules.chi_square_point(2, 0.05) == pytest.approx(5.991465, abs=1e-5)
    assert quality_rules.chi_square_point(4, 0.25) == pytest.approx(5.385269, abs=1e-5)


# ---- mixing -------------------------------------------------------------------------------------------


def test_exponent_meets_target():
    tokens = {"a": 1_000_000, "b": 10_000, "c": 1000}
    for limit in (1.0, 2.0, 4.0, 50.0):
        s = mixing.Settings(repetitions=limit)
        reps = mixing.repetitions(tokens, mixing.weights(tokens, mixing.choose_exponent(tokens, s)), None)
        assert min(reps.values()) == pytest.approx(1) and max(reps.values()) == pytest.approx(limit, rel=1e-6)
    w = mixing.weights(tokens, mixing.choose_exponent(tokens, mixing.Settings(entropy=0.8)))
    assert mixing.entropy(w) == pytest.approx(0.8 * math.log(3), rel=1e-6)


def test_mix_realises_weights(make):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(5, 60)))) for i in range(900)]
    docs = make(rows).where("source IS NOT NULL")
    docs = docs.where("source = 's0' OR doc_id < 300")
    s = mixing.Settings(repetitions=2.5, block_tokens=400)
    out = mixing.mix(docs, s).toPandas()
    base = docs.toPandas()
    base["n"] = base["text"].str.split().str.len()
    for source, part in out.groupby("source"):
        n, want = base.loc[base["source"] == source, "n"], part["mix_weight"].iloc[0]
        assert abs(part["mix_tokens"].sum() / out["mix_tokens"].sum() - want) < 0.02
        epochs = part.groupby("mix_epoch")["doc_id"]
        assert all(epochs.apply(lambda x: x.is_unique))
        full = math.floor(part["mix_tokens"].sum() / n.sum() + 1e-9)
        assert all(set(part.loc[part["mix_epoch"] == e, "doc_id"]) == set(base.loc[base["source"] == source, "doc_id"]) for e in range(full))
    assert set(out["doc_id"]) == set(base["doc_id"])
    # in the partial epoch a source's blocks are whole, but for one
    last = out[out["mix_epoch"] == out.groupby("source")["mix_epoch"].transform("max")]
    for source, part in last.groupby("source"):
        if part["mix_epoch"].iloc[0] > 0:
            every = out[(out["source"] == source) & (out["mix_epoch"] == 0)].groupby("mix_block")["doc_id"].nunique()
            cut = [b for b, n in part.groupby("mix_block")["doc_id"].nunique().items() if n < every[b]]
            assert len(cut) <= 1


def test_mix_of_odd_rows(make):
    docs = make(ODD, **CLASH)
    out = mixing.mix(docs)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
    assert out.where("mix_epoch = 0").count() == len(ODD)
    assert mixing.mix(make([])).count() == 0


# ---- packing ------------------------------------------------------------------------------------------


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def check_packing(rows, out, length=2048):
    want = defaultdict(list)
    for (i, _), ids in zip(rows, reference_ids([t for _, t in rows]), strict=True):
        want[i].append(ids)
    pieces = Counter()
    for r in out:
        match = [x for x in want[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert match and r["length"] > 0
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: sum(map(len, x)) for i, x in want.items()}
    pad = total = 0
    seqs = defaultdict(list)
    for r in out:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        pad += 0 if at & (at - 1) == 0 else length - at
        total += at
    return pad / total


def test_packing_is_whole_and_tight(make):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 9)))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 1500))))) for i in range(250)]
    rows += [(1000, " ".join(rng.choice(vocabulary, 30_000)))]
    assert check_packing(rows, packing.pack(make(rows)).collect()) < 0.01


def test_packing_of_odd_rows(make):
    check_packing(pairs_of(ODD), packing.pack(make(ODD, **CLASH)).collect())
    assert packing.pack(make([])).count() == 0


def test_tokens_equal_library():
    odd = [
        "", "don't stop", "x.'s \"q\" ...y", "a_b__c 3d²", "é é ≮ ≮ €%", "tab\tnl\n\x1cx\x85y　z", "<|endoftext|> x", "İstanbul ΣΑΣ", "%%%&&& word%%%", "1,234.5", "\x00\x01a\x7fb",
        "l'été qu'il 'S'T", "!!wow!!1", "ﬁ ½ Ⅳ", "ÉÀ", "'ll'd we'VE",
    ]
    got = packing.Tokens(None).encode([x.encode() for x in odd])
    assert [x.tolist() for x in got] == [x[:-1].tolist() for x in reference_ids(odd)]


def test_cutting_stock_meets_demand():
    rng = np.random.default_rng(3)
    sizes = np.arange(1, 41)
    demand = rng.integers(1, 200, 40)
    patterns, counts = packing.cutting_stock(sizes, demand.astype(float), 40)
    assert np.allclose(patterns.T @ counts, demand, atol=1e-6) and (patterns @ sizes <= 40).all()
    room = []  # first fit, largest first, in whole sequences: no program needs more
    for size in np.repeat(sizes, demand)[::-1]:
        k = next((i for i, r in enumerate(room) if r >= size), None)
        room.append(40 - size) if k is None else room.__setitem__(k, room[k] - size)
    assert (sizes * demand).sum() / 40 <= counts.sum() <= len(room)
    small, many = np.arange(1, 11), np.full(10, 300)
    assert packing.cutting_stock(small, many.astype(float), 40)[1].sum() == pytest.approx((small * many).sum() / 40, rel=0.01)
    placed = Counter()
    for b, _, _, _, _, n in packing.realise(sizes, demand, 40):
        placed[b] += n
    assert placed == dict(zip(sizes.tolist(), demand.tolist(), strict=True))


# ---- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    once = stages["near-duplicates"](spark, good, sf_dir).cache()
    want = brute_groups(rows, 5)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(i for i, (_, root) in want.items() if root == i)
    cut = stages["repeated passages"](spark, once, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in once.collect()]
    removed = {i: x for (i, _), x in zip(rows, brute_removed(rows, 35), strict=True)}
    got = {r["doc_id"]: r for r in cut.collect()}
    assert set(got) == {i for i, (n, gone, _) in removed.items() if gone < n or n == 0}
    for i, r in got.items():
        text = r["text"] if removed[i][1] else " ".join(WORDS.findall(r["text"]))
        assert hashlib.sha256(text.encode()).hexdigest() == removed[i][2] and r["n_chars"] == len(r["text"])
    mixed = stages["source mixing"](spark, cut, sf_dir).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(got)
    out = stages["packing"](spark, mixed, sf_dir).collect()
    check_packing([(r["doc_id"], r["text"]) for r in mixed.collect()], out)
    assert sum(r["length"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sum(r["length"] for r in out)


def test_rows_repeated_under_one_id_stay_one_document(spark, make):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    a, b, c, d, passage = text(120), text(90), text(60), text(60), text(40)
    c, d = f"{c} {passage}", f"{d} {passage}"
    rows = [(1, a), (1, a), (2, b), (3, c), (3, c), (4, d), (5, a), (6, f"{b} more"), (6, b), (7, None), (7, None), (None, "no id at all"), (None, "no id at all")]
    docs = make(rows)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near-duplicates"](spark, docs, "").cache()
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    assert once.columns == docs.columns
    assert kept(once) == sorted([(1, a), (2, b), (3, c), (4, d), (7, None), (None, "no id at all"), (None, "no id at all")], key=str)
    want = sorted([(1, a), (2, b), (3, c[: -len(passage) - 1]), (4, d[: -len(passage) - 1]), (7, None), (None, "no id at all"), (None, "no id at all")], key=str)
    assert kept(stages["repeated passages"](spark, once, "")) == want
    # the stage by itself, too
    assert kept(stages["repeated passages"](spark, make([(1, a), (1, a), (3, c), (3, c), (4, d)]), "")) == sorted(x for x in want if x[0] in (1, 3, 4))


def test_registered_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {re.match(r"op(\d+)_", n)[1] for n in names if re.match(r"op\d+_", n)} == {str(k) for k in range(1, 11)}
