"""Each operator against its brute-force version, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import random
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auralake.llm import cross_entropy, iso_media, langid, line_runs, packing, simhash, superkmers, tiling, url_rules, wordpiece
from auralake.llm.components import components
from tests.llm import brute

ODD = [None, "", " \n\t", "a", "É è\u0301 \U0001f600 <|endoftext|> x's", "word " * 3000, "x" * 20000]
SCHEMA = "doc_id long, text string, fp string, media string, n_words string, kept string, host string, key string, extra int"


def table(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(k, t, "a", "b", None, "c", "d", "e", i) for i, (k, t) in enumerate(rows)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Texts that share passages, with copies, near copies and odd ones."""
    rng = random.Random(5)
    made = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    shared = [" ".join(rng.choice(made) for _ in range(60)) for _ in range(3)]
    lines = [" ".join(rng.choice(made) for _ in range(6)) for _ in range(8)]
    out = []
    for i in range(60):
        parts = [" ".join(rng.choice(made) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), shared[i % 2])
        if i % 4 == 0:
            at = rng.randint(0, 5)
            parts += lines[at : at + 3]
        out.append("\n".join(parts))
    out += [out[0], out[0], out[1] + " end", out[2].replace("a", "b", 1), *ODD]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows


def test_components_are_those_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(6, 40)] + [(3, 5), (7, 7), (None, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 3 for i in [3, *range(5, 40)]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


class TestMedia:
    def test_round_trip_and_facts(self, spark, corpus):
        made = iso_media.probe_media(iso_media.encode_media(table(spark, corpus), "text"), payload="payload").collect()
        texts = dict(corpus)
        assert len(made) == len(corpus)
        for r in made:
            data = iso_media.pad((texts[r["doc_id"]] or "").encode())
            assert bytes(r["payload"]) == data and r["error"] is None and r["codec"] == "raw "
            assert r["n_samples"] == r["duration"] == len(data) // 64
            media = bytes(r["media"])
            frames = [media[k["offset"] : k["offset"] + k["size"]] for k in r["keyframes"]]
            assert frames == [data[i : i + 64] for i in range(0, len(data), 64 * iso_media.KEYFRAME_EVERY)]

    def test_broken_containers_give_reasons(self, spark):
        whole = iso_media.mux(bytes(range(64)) * 40)
        cut = [whole[:n] for n in range(0, len(whole), 37)]
        noise = [bytes(random.Random(i).randrange(256) for _ in range(90)) for i in range(50)]
        for data in [None, b"", *cut, *noise]:
            found = iso_media.probe(data)
            assert (found["error"] is None) == (found["n_samples"] is not None)
        df = spark.createDataFrame([(1, None), (2, bytearray(whole[:200]))], "id long, media binary")
        assert [r["error"] is not None for r in iso_media.probe_media(df).collect()] == [True, True]

    def test_hostile_tables_give_reasons(self, spark):
        whole = iso_media.mux(bytes(range(64)) * 40)
        at = whole.index(b"stsc") + 4

        def patched(offset, value):
            return whole[: at + offset] + struct.pack(">I", value) + whole[at + offset + 4 :]

        # The second run's first chunk, the runs themselves, and the samples of a chunk.
        hostile = [patched(20, 0xFFFFFFFF), patched(4, 0xFFFFFFFF), patched(12, 0xFFFFFFFF), patched(8, 0xFFFFFFFF), patched(8, 0), patched(20, 1)]
        size, chunks = whole.index(b"stsz") + 8, whole.index(b"stco") + 4
        hostile += [whole[:size] + struct.pack(">II", n, 0xFFFFFFFF) + whole[size + 8 :] for n in (0, 1, 64)]
        hostile += [whole[: chunks + 4] + struct.pack(">I", 0xFFFFFFF0) + whole[chunks + 8 :]]
        wide = whole[: chunks - 4] + b"co64" + whole[chunks : chunks + 4] + struct.pack(">Q", 1 << 63) + whole[chunks + 12 :]
        for data in [*hostile, wide]:
            assert iso_media.probe(data)["error"] and iso_media.demux(data) is None
        rng = random.Random(6)
        for _ in range(3000):
            data = bytearray(whole[:700])
            for _ in range(rng.randint(1, 4)):
                data[rng.randrange(28, 650)] = rng.choice([0, 1, 127, 128, 255])
            found = iso_media.probe(bytes(data) + whole[700:])
            assert (found["error"] is None) == (found["n_samples"] is not None)
        fragments = iso_media._FTYP + iso_media._box(b"moov") + iso_media._box(b"moof") + iso_media._box(b"mdat", bytes(64))
        assert iso_media.probe(fragments)["error"] == "samples in fragments"

    @pytest.mark.parametrize("width", [4, 8, 16])
    def test_compact_sizes(self, width):
        """A track whose samples have sizes of 4, 8 or 16 bits each."""
        sizes = [3, 15, 0, 7, 9]
        body = {4: bytes([0x3F, 0x07, 0x90]), 8: bytes(sizes), 16: struct.pack(">5H", *sizes)}[width]
        table = iso_media._full(b"stz2", struct.pack(">3xBI", width, 5), body)
        chunks = iso_media._full(b"stsc", struct.pack(">IIII", 1, 1, 5, 1)) + iso_media._full(b"stco", struct.pack(">II", 1, 8))
        data = iso_media._box(b"mdat", bytes(range(34))) + table + chunks
        track = {kind: (a, b) for kind, a, b in iso_media.boxes(data, 42, len(data))}
        offsets, found = iso_media.sample_table(data, track)
        assert found.tolist() == sizes and offsets.tolist() == [8, 11, 26, 26, 33]

    def test_digests_of_the_query(self, spark, tmp_path, corpus):
        spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        texts = dict(corpus)
        for r in iso_media.op1_iso_media(spark, str(tmp_path)).collect():
            text = (texts[r["doc_id"]] or "").encode()
            payload = iso_media.pad(text)
            media = iso_media.mux(payload)
            assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(text), len(payload), len(media))
            assert (r["payload_sha256"], r["media_sha256"]) == tuple(hashlib.sha256(x).hexdigest() for x in (payload, media))
            assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["feature"].startswith(f"raw/{len(payload) // 64}:25/{len(payload) // 64}/")

    def test_foreign_layout(self):
        """Sizes per sample, scattered chunks, 64-bit offsets and boxes nested in unknown order."""
        whole = bytearray(iso_media.mux(bytes(range(256)) * 8))
        assert iso_media.demux(bytes(whole) + iso_media._box(b"free", b"xx")) == bytes(range(256)) * 8
        large = bytes(whole[:-2056]) + (1).to_bytes(4, "big") + b"mdat" + (16 + 2048).to_bytes(8, "big") + bytes(whole[-2048:])
        assert iso_media.probe(large)["n_samples"] == 32


class TestSimhash:
    def test_fingerprints_and_components(self, spark, corpus):
        rows = [*corpus, (corpus[0][0], corpus[0][1]), (None, corpus[1][1]), (None, "alone in the world of keys")]
        got = simhash.near_duplicates(table(spark, rows), radius=4).collect()
        prints = [brute.simhash(t) for _, t in rows]
        group = brute.linked(prints, 4)
        least = {g: min((k for (k, _), h in zip(rows, group, strict=True) if h == g and k is not None), default=None) for g in group}
        want = Counter((k, p, least[g]) for (k, _), p, g in zip(rows, prints, group, strict=True))
        assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == want

    @pytest.mark.parametrize("shard_rows", [3, 50_000])
    def test_dense_groups_and_cut_shards(self, spark, shard_rows):
        rng = random.Random(1)
        centre = rng.getrandbits(64)
        points = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
        points = sorted(points)
        df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
        roots = {r["node"] & (1 << 64) - 1: r["root"] for r in components(simhash.links(df, 4, shard_rows)).collect()}
        group = brute.linked(points, 4)
        sizes = Counter(group)
        for p, g in zip(points, group, strict=True):
            assert (p in roots) == (sizes[g] > 1)
        by = {}
        for p, g in zip(points, group, strict=True):
            if p in roots:
                assert by.setdefault(g, roots[p]) == roots[p]
        assert len(set(by.values())) == len(by)

    @pytest.mark.parametrize("seed", range(4))
    def test_tree_prunes_but_loses_nothing(self, seed):
        rng = np.random.default_rng(seed)
        near = np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
        points = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), near, near ^ rng.integers(0, 1 << 20, 300, dtype=np.uint64)]))
        tree = simhash.VantageTree(points, leaf=8)
        label = tree.groups(4)
        assert tree.branches > 10 and tree.pruned > 1000
        at = {p: i for i, p in enumerate(tree.points.tolist())}
        for x, g in zip(points.tolist(), brute.linked(points.tolist(), 4), strict=True):
            assert label[at[x]] == label[at[points.tolist()[g]]]
        assert len(np.unique(label)) == len(set(brute.linked(points.tolist(), 4)))

    @pytest.mark.parametrize("radius", [0, 3, 4, 9])
    def test_every_near_pair_meets_in_a_shard(self, radius):
        rng = np.random.default_rng(radius)
        points = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
        twins = points.copy()
        for bit in rng.integers(0, 64, (radius, len(points))):
            twins ^= np.uint64(1) << bit.astype(np.uint64)
        forest = simhash.routing_forest(points[::8], 1 / 8, radius, 200)
        assert len(forest) == simhash.QUARTERS and all(t.shards > 4 for t in forest)
        met = np.zeros(len(points), bool)
        for tree in forest:
            of = [{s: set(w.tolist()) for s, w in tree.route(x)} for x in (points, twins)]
            for shard, who in of[0].items():
                met[list(who & of[1].get(shard, set()))] = True
        assert met.all()

    def test_trees_branch_and_prune_on_documents(self, spark):
        docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
        points = np.unique(np.array([r["fp"] for r in simhash.fingerprints(docs.select("text")).select("fp").collect()], np.int64).view(np.uint64))
        forest = simhash.routing_forest(points[::64], 1 / 64, 4, simhash.SHARD_ROWS)
        trees = [simhash.VantageTree(points[who]) for router in forest for _, who in router.route(points)]
        for tree in trees:
            tree.groups(4)
        assert len(trees) > simhash.QUARTERS and sum(len(t.points) for t in trees) > len(points)
        assert sum(t.branches for t in trees) > 100 and sum(t.pruned for t in trees) > 10_000

    def test_one_of_each_group_stays(self, spark):
        rows = [(4, "same text of some words here"), (2, "same text of some words here"), (2, "same text of some words here"), (9, "quite another one"), (None, "keyless text"), (None, "keyless text")]
        kept = simhash.keep_first(table(spark, rows))
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, rows[0][1]), (9, rows[3][1]), (None, "keyless text")], key=str)
        assert simhash.keep_first(table(spark, rows).where("false")).count() == 0

    def test_rows_of_one_key_are_told_apart(self, spark):
        x, y, z = "one text of some words", "another text with other words", "the third has nothing in common"
        kept = simhash.keep_first(table(spark, [(0, y), (1, x), (1, y)]))
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, y), (1, x)]
        kept = simhash.keep_first(table(spark, [(1, x), (1, z)]))
        assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, x), (1, z)])


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x?q", "http://www.example.com/en/", "http://a.www.Example.com/en", "http://notexample.com/en/1", "ftp://b.net/es/#x", "x://net/fr/9", "http://com", "http://com/", "http://a..com/", "http://u@example.com:80/en/", "a://b://c.com/d", "http://é.net/fr/ü", "http://" + "a." * 300 + "com/" + "p/" * 2000]


def test_url_rules(spark):
    rows = [(i, u, "h", None, 1) for i, u in enumerate(URLS + URLS[3:6])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, extra int")
    rules = spark.createDataFrame([*url_rules.RULES, (None, "/", "block")], "host string, path string, verdict string")
    want = {i: brute.verdict(u, url_rules.RULES) for i, u, *_ in rows}
    got = url_rules.judge(df, rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == want and len(got) == len(rows)
    url_rules_limit, url_rules.BROADCAST_RULES = url_rules.BROADCAST_RULES, 1
    try:
        salted = url_rules.judge(df, rules).collect()
    finally:
        url_rules.BROADCAST_RULES = url_rules_limit
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in salted} == want
    assert url_rules.judge(df.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judge(df, rules.where("false")).collect()} == {"allow"}


class TestWordPieces:
    @settings(max_examples=300, deadline=None)
    @given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=12), st.text("abc", max_size=15))
    def test_automaton_is_greedy_longest_match(self, vocabulary, word):
        assert wordpiece.Automaton(sorted(vocabulary)).count(word) == brute.pieces(word, vocabulary)

    def test_texts(self, spark, corpus):
        vocabulary = set(wordpiece.load_pieces(public_tokenizers.path("word_bpe_49k.json")))
        letters = wordpiece.byte_alphabet()

        def want(text):
            found = wordpiece.WORDS.findall(__import__("unicodedata").normalize("NFC", text or "").lower())
            return len(found), sum(brute.pieces("".join(letters[b] for b in w.encode()) + wordpiece.END, vocabulary) for w in found)

        long = [(2000, "x" * 1500 + " " + "word, " * 20_000), (2001, corpus[0][1]), (2001, corpus[0][1])]
        got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in wordpiece.count_tokens(table(spark, corpus + long)).collect()}
        assert len(got) == len(corpus) + 2 and all(got[k] == want(t) for k, t in corpus + long)
        assert wordpiece.count_tokens(table(spark, corpus).where("false")).count() == 0


class TestTiling:
    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=40))
    def test_marks_what_plain_tiling_marks(self, item, text):
        got = tiling.tile(np.array(item, np.int64), np.array(text, np.int64), 3)
        covered = [0] * len(item)
        for i, j, n in got:
            assert item[i : i + n] == text[j : j + n] and n >= 3
            for x in range(i, i + n):
                covered[x] += 1
        assert max(covered, default=0) <= 1
        first = max((n for _, _, n in got), default=0)
        longest = max((n for i in range(len(item)) for j in range(len(text)) for n in range(1, 1 + min(len(item) - i, len(text) - j)) if item[i : i + n] == text[j : j + n]), default=0)
        assert first == (longest if longest >= 3 else 0)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=40))
    def test_both_ways_mark_the_same(self, item, text):
        item, text = np.array(item, np.int64), np.array(text, np.int64)
        heap = tiling.tile(item, text, 3)
        most, tiling.MOST_STARTS = tiling.MOST_STARTS, 0
        try:
            assert tiling.tile(item, text, 3) == heap
        finally:
            tiling.MOST_STARTS = most
        assert sum(n for *_, n in heap) == brute.tiles(item.tolist(), text.tolist(), 3)

    def test_repetitive_texts_and_shared_seeds_stay_small(self):
        """An item of 3,000 equal words against 60,000; a text that repeats a seed of 20,000 items."""
        tracemalloc.start()
        found = list(tiling.Block([(1, "same " * 3000)], 4, 0.6).of_text("same " * 60_000))
        assert [(k, c) for k, c, _ in found] == [(1, 1.0)]
        items = [(i, f"one shared seed here own{i} words{i} follow{i} it{i}") for i in range(20_000)]
        block = tiling.Block(items, 4, 0.6)
        assert not list(block.of_text("one shared seed here " * 20_000))
        assert [k for k, *_ in block.of_text("one shared seed here " * 20_000 + items[7][1])] == [7]
        assert tracemalloc.get_traced_memory()[1] < 1 << 30
        tracemalloc.stop()

    def test_coverage_equals_brute_force_on_distinct_words(self):
        rng = random.Random(2)
        for _ in range(60):
            item = list(range(30))
            parts = [item[a : a + rng.randint(2, 9)] for a in rng.sample(range(25), 4)]
            text = [x for p in parts for x in [*p, 99]]
            got = sum(t[2] for t in tiling.tile(np.array(item), np.array(text), 3))
            assert got == brute.tiles(item, text, 3)

    def test_copies_reordered_and_clean(self, spark):
        item = "the quick brown fox jumps over the lazy dog while seven wizards boil the green soup at night"
        w = item.split()
        docs = [(1, f"before {item} after"), (2, " ".join(w[9:] + ["and"] + w[:9])), (3, item.upper().replace(" ", ",\n")), (4, "the quick brown fox is not here at night"), (5, None), (6, ""), (7, " ".join(w[:5])), (1, f"before {item} after"), (8, "clean " * 5000)]
        bench = spark.createDataFrame([(11, item), (12, None), (13, "too short"), (14, "some other text that nothing here has at all")], "item_id long, text string")
        for block_chars in (16 << 20, 40):
            got = tiling.contaminated(table(spark, docs), bench, block_chars=block_chars).collect()
            assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 11), (1, 11), (2, 11), (3, 11)]
            assert all(r["coverage"] == pytest.approx(1) for r in got)
            left = tiling.uncontaminated(table(spark, docs), bench, block_chars=block_chars)
            assert sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 8] and left.columns == table(spark, docs).columns
        assert tiling.contaminated(table(spark, docs), bench.where("false")).count() == 0


class TestPacking:
    def test_every_id_once_and_little_padding(self, spark, corpus):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        want = {k: coder.encode(t or "", add_special_tokens=False).ids + [2] for k, t in corpus}
        rows = packing.pack_documents(table(spark, corpus), capacity=256).collect()
        found = {k: [] for k in want}
        for r in sorted(rows, key=lambda r: r["start"]):
            ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
            assert len(found[r["doc_id"]]) == r["start"] and len(ids) == r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
            found[r["doc_id"]] += ids
        assert found == want
        sequences = {}
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert sequences.get(r["sequence_id"], 0) == r["offset"]
            sequences[r["sequence_id"]] = r["offset"] + r["length"]
        assert all(n == 256 or n & (n - 1) == 0 for n in sequences.values())
        digest = packing.digests(packing.pack_documents(table(spark, corpus))).collect()
        assert all(r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in digest)

    @pytest.mark.parametrize("tokens", [1, 3, 5, 7, 9, 300])
    @pytest.mark.parametrize("loss", [4096, 700])
    def test_no_padding_where_another_limit_binds(self, tokens, loss):
        packer, sequences = packing.Packer((4096, 512, loss), cut=True), []
        for i in range(3000):
            while packer.full():
                sequences.append(packer.sequence())
            packer.add(i, 0, (tokens, 1, tokens))
        sequences += packer.drain()
        sizes = [sum(n for *_, n in x) for x in sequences]
        assert sum(sizes) == 3000 * tokens and all(n == 4096 or n & (n - 1) == 0 for n in sizes)
        assert all(len(x) <= 512 for x in sequences) and max(sizes) <= loss

    def test_takes_what_the_plain_heuristic_takes(self):
        rng = random.Random(7)
        packer, open_ = packing.Packer((100, 6, 50), cut=False, room=40), {}
        for i in range(40):
            open_[i] = (rng.randint(1, 60), rng.randint(1, 3), rng.randint(0, 40))
            packer.add(i, 0, open_[i])
        for sequence in packer.drain():
            assert [i for i, *_ in sequence] == brute.dot_product_bin(open_, (100, 6, 50))
        assert not open_

    def test_ids_are_those_of_the_tokenizer(self, spark):
        """A random sample of whole documents and of odd strings."""
        from tokenizers import Tokenizer

        path = public_tokenizers.path("word_bpe_49k.json")
        coder, ids = Tokenizer.from_file(path), packing.token_ids(path)
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        texts = [r["text"] for r in docs.sample(0.2, seed=3).select("text").collect()]
        rng = random.Random(11)
        alphabet = "abcXYZ'’.,;:!?-_/0189 \t\n\u00e9\u0301\u00df\u0130\u03c3\u03c2\u4e2d\U0001f600\u200b\u00a0"
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
        want = [coder.encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.of(texts)] == want

    def test_conversations_under_three_limits(self, spark):
        """Turns of an assistant bear loss; each limit is met by some sequence."""
        turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
        size = F.size(F.split("text", " ")).cast("int")
        df = turns.groupBy("conv_id").agg(F.sum(size).alias("t"), F.count("*").alias("s"), F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("l"))
        rows = {r["conv_id"]: r for r in df.collect()}
        # In proportion to the corpus, so that each limit binds somewhere.
        capacity = tuple(-(-10 * sum(r[c] for r in rows.values()) // len(rows)) for c in "tsl")
        got = packing.pack_items(df.coalesce(1), "conv_id", "t", "s", "l", capacity).collect()
        assert sorted(r["conv_id"] for r in got) == sorted(rows)
        total = {}
        for r in got:
            if not r["oversize"]:
                own = rows[r["conv_id"]]
                total[r["sequence_id"]] = [a + b for a, b in zip(total.get(r["sequence_id"], (0, 0, 0)), (own["t"], own["s"], own["l"]), strict=True)]
        assert all(x <= c for found in total.values() for x, c in zip(found, capacity, strict=True))
        assert all(any(found[d] > 0.97 * capacity[d] for found in total.values()) for d in range(3))

    def test_rows_that_repeat_and_none(self, spark):
        rows = [(None, "a b"), (None, "a b"), (3, None), (3, None)]
        assert packing.pack_documents(table(spark, rows)).groupBy("doc_id").agg(F.sum("length").alias("n")).orderBy("doc_id").collect() == [(None, 6), (3, 2)]
        assert packing.pack_documents(table(spark, rows).where("false")).count() == 0

    def test_whole_examples_keep_all_limits(self, spark):
        rng = random.Random(4)
        rows = [(i, rng.randint(1, 90), rng.randint(1, 5), rng.randint(0, 60)) for i in range(400)] + [(1000, 101, 1, 1), (1001, None, None, None)]
        df = spark.createDataFrame(rows, "id long, t int, s int, l int").repartition(2)
        got = packing.pack_items(df, "id", "t", "s", "l", (100, 8, 70)).collect()
        need = {i: (t or 0, s or 0, x or 0) for i, t, s, x in rows}
        total = {}
        for r in got:
            total[r["sequence_id"]] = [a + b for a, b in zip(total.get(r["sequence_id"], (0, 0, 0)), need[r["id"]], strict=True)]
        assert sorted(r["id"] for r in got) == sorted(need) and [r["id"] for r in got if r["oversize"]] == [1000]
        assert all(t <= 100 and s <= 8 and x <= 70 for t, s, x in total.values() if t != 101)
        assert len(total) < 1.35 * sum(n[0] for n in need.values()) / 100 + 4


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_runs(spark, corpus, least):
    rows = [*corpus, (500, "a\nb\nc\na\nb\nc\na\nb"), (501, "x\n\n \na\nb\n\nc\nz"), (502, "\n" * 40), (503, "a\nb\nc"), (504, "same\n" * 200), (505, "z\n\x0b\nq\nb\nc"), (506, "c\na\nb\nc\na")]
    got = line_runs.dedup_lines(table(spark, rows), min_lines=least).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == brute.without_runs(rows, least) and len(got) == len(rows)
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got} == brute.maximal_runs(rows, least)


def test_random_line_runs(spark):
    rng = random.Random(12)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]
    got = line_runs.dedup_lines(table(spark, rows)).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got} == brute.maximal_runs(rows, 1)


def test_overlapping_runs_are_told_apart(spark):
    got = {r["doc_id"]: r for r in line_runs.dedup_lines(table(spark, [(1, "A\nB"), (2, "B\nC"), (3, "A\nB\nC")])).collect()}
    assert {k: [tuple(x) for x in r["runs"]] for k, r in got.items()} == {1: [(0, 2)], 2: [(0, 2)], 3: [(0, 2), (1, 2)]}
    assert {k: r["kept"] for k, r in got.items()} == {1: "A\nB", 2: "C", 3: ""}


def test_line_runs_of_odd_tables(spark):
    repeated = line_runs.dedup_lines(table(spark, [(7, "p\nq\nr"), (7, "p\nq\nr"), (8, "p\nq\nr"), (None, "p\nq\nr")]), min_lines=2).collect()
    assert sorted(((r["doc_id"], r["kept"]) for r in repeated), key=str) == sorted([(7, "p\nq\nr"), (7, "p\nq\nr"), (8, ""), (None, "")], key=str)
    lone = line_runs.dedup_lines(table(spark, [(7, "p\nq"), (7, "p\nq"), (9, None)])).collect()
    assert sorted((r["doc_id"], r["kept"], r["n_deleted"], len(r["runs"])) for r in lone) == [(7, "p\nq", 0, 0), (7, "p\nq", 0, 0), (9, None, 0, 0)]
    assert line_runs.dedup_lines(table(spark, [(7, "p")]).where("false")).count() == 0


def test_line_runs_sql_on_null_and_empty_texts(spark, tmp_path):
    import duckdb

    rows = [(1, "a\nb"), (2, None), (3, ""), (4, "b\n \na"), (5, "a\nb\na\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = line_runs.op7_line_runs(spark, str(tmp_path))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(base.sql(line_runs.OP7_SQL).fetchall())


class TestCrossEntropy:
    @pytest.mark.parametrize("block_bytes,bucket_bytes", [(1, 30_000), (20_000, 1 << 30), (8 << 20, 10_000), (3_000, 20)])
    def test_scores_are_those_of_plain_counting(self, spark, corpus, block_bytes, bucket_bytes):
        rows = [*corpus, corpus[0], (None, "a b a b keyless")]
        target = {k for k, _ in rows if k is not None and k % 2 == 0}
        labels = spark.createDataFrame([(k, 1) for k in target] + [(None, 1), (min(target), 1), (10**6, 1)], "doc_id long, quality int")
        got = cross_entropy.score_documents(table(spark, rows), labels, F.col("quality") == 1, block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
        want = brute.cross_entropies(rows, target, cross_entropy.MU)
        assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(map(str, (k for k, _ in rows)))
        by = {}
        for (k, _), w in zip(rows, want, strict=True):
            by[k] = w
        for r in got:
            if by[r["doc_id"]] is None:
                assert (r["n_tokens"], r["ce_target"], r["ce_background"], r["ce_difference"]) == (0, None, None, None)
            else:
                assert (r["n_tokens"], r["ce_target"], r["ce_background"]) == pytest.approx(by[r["doc_id"]])
                assert r["ce_difference"] == pytest.approx(by[r["doc_id"]][1] - by[r["doc_id"]][2])

    def test_like_the_target_is_lower(self, spark):
        rng = random.Random(0)
        of = lambda words: " ".join(rng.choice(words) for _ in range(60))
        good, bad = "alpha beta gamma delta epsilon zeta".split(), "one two three four five six".split()
        rows = [(i, of(good if i % 2 else bad)) for i in range(60)]
        labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (1, 1)], "doc_id long, quality int")
        scores = {r["doc_id"]: r["ce_difference"] for r in cross_entropy.score_documents(table(spark, rows), labels, F.col("quality") == 1).collect()}
        assert max(scores[i] for i in range(1, 60, 2)) < min(scores[i] for i in range(0, 60, 2))
        none = cross_entropy.score_documents(table(spark, rows), labels.where("false"), F.col("quality") == 1)
        assert none.where("ce_difference is null").count() == 0 and none.count() == 60
        assert cross_entropy.score_documents(table(spark, rows).where("false"), labels, F.col("quality") == 1).count() == 0


class TestSuperkmers:
    @pytest.mark.parametrize("k,m,buckets", [(50, 8, 5), (6, 3, 2), (3, 8, 7)])
    def test_windows(self, spark, corpus, k, m, buckets):
        rows = [*corpus, (700, "u v w x y z " * 20), (701, "u v w x y z " * 20), (701, "other words " * 30), (None, "u v w x y z " * 20), (702, None)]
        got = superkmers.dedup(table(spark, rows), k=k, m=m, buckets=buckets).collect()
        want = brute.without_windows(rows, k)
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == Counter(want)

    def test_hot_minimisers_take_the_other_way(self, spark):
        rng = random.Random(8)
        hot = " ".join(f"h{i}" for i in range(70))
        rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + hot + f" t{i}") for i in range(120)]
        df = table(spark, rows)
        assert superkmers.hot_minimisers(df.select("doc_id", "text"), "text", 50, 8, 16, 120)
        got = superkmers.dedup(df, buckets=16).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got) == Counter(brute.without_windows(rows, 50))

    def test_empty(self, spark):
        assert superkmers.dedup(table(spark, [(1, "a")]).where("false")).count() == 0


class TestLanguage:
    def test_held_out_accuracy_and_rejection(self, spark):
        rng = random.Random(3)
        tongues = {"aa": "the and with from that this house water".split(), "bb": "der und mit von dass dieses haus wasser".split(), "cc": "le et avec de que cette maison eau".split()}
        rows = [(i, " ".join(rng.choice(tongues[name]) for _ in range(rng.randint(5, 60))), name) for i, name in enumerate(list(tongues) * 40)]
        rows += [(900, None, "aa"), (901, "", None), (902, "123 ... !!", "bb"), (903, "ζήτα κάππα " * 20, None), (None, "the and with", "aa"), (5, rows[5][1], rows[5][2])]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
        model = langid.fit(df.where(~langid.held_out()))
        got = langid.identify(df, model).withColumn("held", langid.held_out()).collect()
        assert all(r["lang_pred"] == r["lang"] for r in got if r["held"] and r["doc_id"] < 900)
        assert all(r["held"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
        assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {900, 901, 902} and all(0 <= r["score"] <= 1 for r in got)
        assert {r["doc_id"] for r in got if r["rejected"]} == {900, 901, 902, 903}
        assert langid.recognised(df).columns == df.columns

    def test_letters_decide_what_is_undetermined(self):
        model = langid.Centroids(np.ones(langid.DIM), np.eye(2, langid.DIM), ["aa", "bb"], [0.1, 0.1])
        assert [model.judge(t)[0] for t in ("²", "½", "Ⅷ", "7", None, "", " \n")] == ["und"] * 7
        assert all(model.judge(t)[0] in ("aa", "bb") for t in ("a", "x1y2", "ª", "é", "字", "a" * 2_000_000))

    @pytest.mark.parametrize("one", range(3))
    def test_one_key_on_all_rows(self, spark, one):
        tongues = {"aa": "the and with from that this house water", "bb": "der und mit von dass dieses haus wasser"}
        rows = [(one, f"{tongues[name]} {'z' * (i % 50 + 1)}", name) for i, name in enumerate(list(tongues) * 400)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = langid.fit(df)
        assert set(model.languages) == {"aa", "bb"}
        assert langid.identify(df, model).where("lang_pred <> lang").count() == 0
        same = langid.fit(df.withColumn("text", F.lit("the same text")))
        assert set(same.languages) == {"aa", "bb"} and langid._examples(df.withColumn("text", F.lit("the same text")), "doc_id", "text", "lang", 400).count() == 2

    def test_three_hundred_languages(self, spark):
        rng = random.Random(1)
        words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for i in range(300)}
        rows = [(i, " ".join(rng.choices(words[name], k=12)), name) for i, name in enumerate(list(words) * 3)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
        model = langid.fit(df)
        assert len(set(model.languages)) == 300
        assert langid.identify(df, model).where("lang_pred <> lang").count() == 0

    def test_the_sample_is_bounded(self, spark):
        rows = [(i, f"text number {i} of many with words", "aa" if i % 3 else "bb") for i in range(3000)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert {r["label"]: r["count"] for r in langid._examples(df, "doc_id", "text", "lang", 100).groupBy("label").count().collect()} == {"aa": 100, "bb": 100}

    def test_nothing_to_learn_from(self, spark):
        df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
        assert langid.identify(df, langid.fit(df)).first()["lang_pred"] == "und"
