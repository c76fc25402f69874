"""Stages of the pipeline, with planted copies, against brute force."""

from __future__ import annotations

import base64
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tests.llm import brute

from auralake.llm import near_copies, session

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA).repartition(3)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike_first(rows):
    """Keys of the rows that stay: the first of each component at a Jaccard of 0.8."""
    sets, seen, stay = [shingle_set(t) for _, t in rows], set(), set()
    for i in sorted(range(len(rows)), key=lambda i: rows[i][0]):
        if i in seen:
            continue
        stay.add(rows[i][0])
        todo = [i]
        while todo:
            a = todo.pop()
            seen.add(a)
            todo += [b for b in range(len(rows)) if b not in seen and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return stay


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.randrange(10**6)}"
    return out


def test_near_dedup_finds_all_pairs_of_jaccard_08(spark):
    rng, rows = random.Random(4), []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 200, 700]))]
        rows += [(len(rows), " ".join(base))]
        for n in (1, 2, 3, 4, 6, 9):
            rows += [(len(rows), " ".join(edited(rng, base, min(n * len(base) // 200 + 1, len(base)))))]
    rows += [(900 + i, t) for i, t in enumerate(["", None, "one two", "One  two", "two one", rows[0][1]])]
    got = corpus_pipeline.near_dedup(spark, documents(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(alike_first(rows))
    for block in (300, 20000):  # components in many parts
        parted = near_copies.keep_first(documents(spark, rows), block=block)
        assert sorted(r["doc_id"] for r in parted.collect()) == sorted(alike_first(rows))
    repeated = corpus_pipeline.near_dedup(spark, documents(spark, [(7, "a b c"), (7, "a b c"), (None, "a b c"), (None, "x"), (None, "x")]), "")
    assert sorted(map(str, (r["doc_id"] for r in repeated.collect()))) == ["7", "None"]
    assert corpus_pipeline.near_dedup(spark, documents(spark, rows).where("false"), "").count() == 0


def test_fingerprints_of_alike_texts_lie_within_the_radius():
    """The chance to lie beyond it, of bits that differ with 0.1875 at most, and pairs of all sizes at 0.8 or little more."""
    bits, p = near_copies.FP_BITS, 0.1875
    assert sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(near_copies.RADIUS + 1, bits + 1)) < 4e-9
    rng = np.random.default_rng(1)
    for shared, a, b in [(4, 0, 1), (8, 1, 1), (12, 1, 2), (16, 2, 2), (80, 10, 10), (400, 0, 100), (4000, 500, 500)]:
        for _ in range(30):
            found = rng.integers(0, 1 << 63, shared + a + b, dtype=np.uint64)
            one, other = near_copies.fingerprint(found[: shared + a]), near_copies.fingerprint(np.delete(found, np.s_[shared : shared + a]))
            assert np.bitwise_count(one ^ other).sum() <= near_copies.RADIUS
    assert np.bitwise_count(near_copies.fingerprint(found[:300]) ^ near_copies.fingerprint(found[300:600])).sum() > near_copies.RADIUS


def test_the_tree_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    chance = rng.integers(0, 1 << 63, (40, 1, 8), dtype=np.uint64)
    flips = rng.random((40, 30, 512)) < rng.choice([0.02, 0.1, 0.2], (40, 1, 1))
    points = (chance ^ np.packbits(flips, axis=2).view("<u8")).reshape(-1, 8)
    points = points[rng.permutation(np.append(np.arange(1200), [0, 0, 7]))]
    near = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=2) <= near_copies.RADIUS
    want = np.arange(len(points))
    while (next_ := np.where(near, want[None], len(points)).min(axis=1)).tolist() != want.tolist():
        want = next_
    got = near_copies.similar(points, leaf=8)
    assert got[got].tolist() == got.tolist()
    assert len(set(zip(got.tolist(), want.tolist(), strict=True))) == len(set(got.tolist())) == len(set(want.tolist()))
    tree = near_copies.WideTree(np.unique(points, axis=0), 8)
    tree.groups(near_copies.RADIUS)
    assert tree.branches > 0 and tree.pruned > 0


def test_near_dedup_links_what_the_trees_of_fingerprints_found(spark):
    """At a radius of 0 only texts of one fingerprint are linked, though they share bands and shingles."""
    base = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(["less", *base])), (4, " ".join(base).upper()), (5, "another text of six words")]
    kept = lambda **options: sorted(r["doc_id"] for r in near_copies.keep_first(documents(spark, rows), **options).collect())
    assert kept() == sorted(alike_first(rows)) == [1, 5]
    prints = {near_copies.fingerprint(near_copies.shingles(t)).tobytes() for _, t in rows}
    assert len(prints) == 4 and kept(radius=0) == kept(radius=0, block=300) == [1, 2, 3, 5]


@pytest.mark.parametrize("hot_keys", [1, 3])
def test_near_dedup_of_sets_that_many_rows_share(spark, monkeypatch, hot_keys):
    """With 1 every set is shuffled, with 3 those of over a third of the rows are broadcast."""
    monkeypatch.setattr(session, "HOT_KEYS", hot_keys)
    base = [f"w{i}" for i in range(60)]
    rows = [(10 + i, " " * i + " ".join(base)) for i in range(40)]
    rows += [(5, " ".join([*base, "more"])), (3, "quite another text of seven words"), (4, None), (60, ""), (61, " ".join(base[:30]))]
    got = sorted(r["doc_id"] for r in near_copies.keep_first(documents(spark, rows)).collect())
    assert got == sorted(alike_first(rows)) == [3, 4, 5, 61]


def test_line_dedup_deletes_single_repeated_lines(spark):
    rows = [(1, "a b\nown one\nc d"), (2, "own two\na b\n\nown three\na b"), (3, "c d\na b"), (4, "x\n" * 3), (5, ""), (6, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), "").collect()}
    want = brute.without_runs(rows, 1)
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, t in want.items() if k != 3}
    assert all(n == len(t or "") for t, n in got.values())


def test_language_id_drops_gibberish_and_other_languages(spark):
    rng = random.Random(9)
    tongues = {
        "en": "the and with from that this house water all people are born free should act towards another spirit".split(),
        "de": "der und mit von dass dieses haus wasser alle menschen sind frei geboren sollen einander geist begegnen".split(),
    }
    rows = [(i, " ".join(rng.choice(tongues[lang]) for _ in range(rng.randint(1, 60))), lang) for i, lang in enumerate(list(tongues) * 200)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(60)) for _ in range(2)]
    rows += [(900, noise[0], "en"), (901, noise[1], None), (902, base64.b64encode(rng.randbytes(2250)).decode(), None), (903, rng.randbytes(1500).hex(), None)]
    rows += [(904, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", None), (905, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got == {k for k, *_ in rows if k < 900}


ODD = [(1, None), (None, "the people of this house number 3 and the water"), (2, ""), (3, " \n\t"), (4, "x" * 20_000), (5, "the water and the house " * 9000), (6, "same text of the water"), (6, "same text of the water"), (7, "same text of the water"), (7, "other text for that house")]


def odd_table(spark):
    """Nulls in every column, an empty and a very long text, ties, repeated rows, and columns with the names of outputs."""
    rows = [(k, t, None if i % 3 else "en", None, None, "a", 1.5, "b", i) for i, (k, t) in enumerate(ODD)]
    rows += [(100 + i, f"the people of this house number {i} and the water", "en", "s", 1, "a", 0.5, "b", i) for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA + ", kept string, score double, lang_pred string, sequence_id long").repartition(3)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    docs, folder = odd_table(spark), "/root/testdata/sf0.001"
    got = stage(spark, docs, folder)
    found = got.collect()
    assert stage(spark, docs.where("false"), folder).count() == 0
    if name == "packing":
        assert sum(r["length"] for r in found if r["doc_id"] == 6) == 2 * [r["doc_tokens"] for r in found if r["doc_id"] == 6][0]
        return
    assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
    keys = [r["doc_id"] for r in found]
    assert {100 + i for i in range(40)} <= set(keys)
    gone = {"language_id": {1, 2, 3}, "line_dedup": {7}, "near_dedup": {2, 3}, "decontaminate": set()}[name]
    assert not gone & {r["doc_id"] for r in found if name != "line_dedup" or "same text" in (r["text"] or "")}
    assert keys.count(6) == (1 if name == "near_dedup" else 2) and 5 in keys and (None in keys) == (name in ("language_id", "decontaminate"))


def test_the_whole_pipeline_on_planted_documents(spark, tmp_path):
    """Stage after stage against plain Python on what the stage before kept."""
    rng = random.Random(3)
    words = "the and with from that this house water all people are born free should act towards another spirit of in to for on as by at".split()
    plain = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = plain(40)
    rows = [(i, "\n".join(plain(rng.randint(20, 60)) for _ in range(3))) for i in range(120)]
    base = plain(400).split()
    near = [(200 + i, " ".join(edited(rng, base, i))) for i in range(4)]
    rows += [*near, (210, rows[5][1]), (211, plain(80) + "\n" + rows[7][1].split("\n")[1]), (212, plain(30) + " " + item + " " + plain(30)), (213, "\u03b6\u03ae\u03c4\u03b1 " * 50)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [(k, t) for k, t in rows if k != 213]
    lines = brute.without_runs(left, 1)
    left = [(k, lines[k]) for k, t in left if lines[k] == t or (lines[k] or "").strip()]
    stay = alike_first(left)
    left = [(k, t) for k, t in left if k in stay and k != 212]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in left} and not {201, 202, 210, 212, 213} & {k for k, _ in left}
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for key, text in left:
        ids = coder.encode(text, add_special_tokens=False).ids + [2]
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == key)
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(c == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n, c in pieces)
