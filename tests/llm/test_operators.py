"""The operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallygrid.llm import common, components, decontaminate, fingerprints, language_id, licenses, packing, quality, simhash, similar, suffix_dedup, suffixes, token_files, url_filters
from tests.conftest import same_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, run int, f long, canon string"
LARGER = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor sit amet consectetur " * 900
REPEAT = "one passage that stands in several documents word for word and is surely longer than a hundred bytes, as it must be."
ODD = [
    (1, "Hello there, GNU General Public License and CC BY-NC 4.0. " + REPEAT, "en", "a"),
    (2, None, "en", "a"),
    (3, "", "en", None),
    (4, "   \n\t ", None, "b"),
    (5, LONG, "de", "a"),
    (5, LONG, "de", "a"),
    (None, "No id here. All rights reserved. " + REPEAT, "en", "b"),
    (7, "é" * 300 + " ÀÉ ß ² don't <|endoftext|> ‘x’ 中文", "fr", "a"),
    (8, REPEAT, "en", "b"),
    (9, REPEAT, "en", "b"),
    (10, "x", "en", "b"),
    (11, "1234 5678 !!!", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every oddity, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 0, "x", 1, 2, "y") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def ordered(rows):
    """Rows in the order of the operators: doc_id with null first, then text with null first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def pairs(df):
    return ordered([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_language_identification(spark, docs, odd, empty):
    model = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    rows = language_id.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(x).encode()) % 4 == 2 for x in held.doc_id]).all()
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert rows.score.between(0, 1).all()
    got = language_id.identify_languages(odd, model).toPandas()
    assert len(got) == len(ODD)
    letters = {r[0]: bool(r[1]) and any(c.isalpha() for c in r[1]) for r in ODD}
    for r in got.itertuples():
        key = None if np.isnan(r.doc_id) else int(r.doc_id)
        assert (r.lang_pred != "und") == letters[key] and (r.lang_pred != "und" or r.score == 0)
    assert language_id.identify_languages(empty, model).count() == 0
    assert language_id.train(empty) is None
    assert {r["lang_pred"] for r in language_id.identify_languages(odd, None).collect()} == {"und"}


def test_language_model_against_plain_loops(docs):
    """Counts, log-odds, decoding and the flag of ambiguity, worked out without the library's array code."""
    taught = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model, size = language_id.train(taught), language_id.DIMS

    def codes(text):
        low = [b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()]
        words = [low[k] << 16 | low[k + 1] << 8 | low[k + 2] for k in range(len(low) - 2)]
        return [(w * 2654435761 & 0xFFFFFFFF) >> 16 for w in words if w != 0x202020]

    counts = {x: np.zeros(size) for x in model.langs}
    for r in taught.collect():
        if r["text"] and r["lang"]:
            np.add.at(counts[r["lang"]], codes(r["text"]), 1)
    share = {x: (n + 0.5) / (n.sum() + 0.5 * size) for x, n in counts.items()}
    for b in range(model.code.shape[1]):
        side = [np.mean([share[x] for x, word in zip(model.langs, model.code, strict=True) if word[b] == s], axis=0) for s in (1, -1)]
        assert np.allclose(model.weights[:size, b], np.log(side[0] / side[1]), atol=1e-4)
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs, model).collect()}
    for r in docs.limit(25).collect():
        if not codes(r["text"] or ""):
            continue
        margin = np.mean([model.weights[c] for c in codes(r["text"])], axis=0) / model.scale
        loss = [sum(t * np.exp(-np.clip(m, -4, 4) * w) for m, w, t in zip(margin, word, trust, strict=True)) for word, trust in zip(model.code, model.trust, strict=True)]
        p = np.exp(-language_id.SHARPNESS * (np.array(loss) - min(loss)))
        p = np.sort(p / p.sum())[::-1]
        own = got[r["doc_id"]]
        if own["lang_pred"] != "und":
            assert abs(own["score"] - p[0]) < 1e-3 and (own["ambiguous"] == (p[0] - p[1] < 0.1) or abs(p[0] - p[1] - 0.1) < 1e-3)


def test_codebooks_tell_languages_apart():
    for k in (2, 3, 5, 9, 30):
        code = language_id.codebook(k)
        assert len(code) == k and min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 1


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_files_round_trip(spark, odd, empty, tmp_path, kind):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_files.vocabulary_path())
    path = token_files.write_token_files(odd, str(tmp_path / kind), kind=kind)
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text in pairs(odd):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    path = token_files.write_token_files(empty, str(tmp_path / f"{kind}-empty"), kind=kind)
    assert token_files.read_token_files(spark, path).count() == 0


def thue_morse(doublings):
    text = "a"
    for _ in range(doublings):
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def encoded_by(tokenizer, texts):
    raw = [t.encode() for t in texts]
    ids, n = tokenizer.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_memory_is_given_back_after_each_run_of_texts(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    write = token_files.segment_writer(token_files.vocabulary_path(), "byte")
    for k in range(3):
        texts = pa.table({"doc_id": pa.array([2, 1]), "text": pa.array(["two words", None])})
        out = write(pa.table({"run": pa.array([k], pa.int32()), "block": pa.array([common.packed(texts)], pa.binary())}))
        assert out.column("doc_ids").to_pylist() == [[1, 2]] and len(given) == k + 1


def test_memory_is_given_back_by_stages_before_and_after_the_repeats(monkeypatch):
    given = []
    for module in (common, quality):
        monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    rows = {"shard": [0, 0], "doc_id": [1, 2], "piece": [0, 0], "source": ["a", "b"], "n_words": [3, 4], "cluster": [1, 2]}
    assert packing.shard_packer(10)(pa.table(rows)).num_rows == 2 and len(given) == 1
    batch = pa.RecordBatch.from_pydict({"text": ["", None]})
    model = type("Half", (), {"score": lambda self, x: np.full(len(x), 0.5)})()
    assert [b.num_rows for b in quality.sieve(model, 0.4, 0)(iter([batch]))] == [2] and len(given) == 2


def test_tokens_are_those_of_the_library(monkeypatch):
    """Words whose polynomial hashes agree, pieces on both sides of 16 bytes, and pieces forced to share a hash."""
    tokenizer = token_files.WordTokenizer(token_files.vocabulary_path())
    word = thue_morse(10)
    texts = [word, word.translate(str.maketrans("ab", "ba")), "", "don't DON'T " + word[:17], word[:16], word[:17], "é É x", *(t or "" for _, t, *_ in ODD)]
    want = [[*tokenizer.whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert tokenizer.fast and encoded_by(tokenizer, texts) == want
    tokenizer.clear()
    marks = tokenizer.marks
    monkeypatch.setattr(tokenizer, "marks", lambda *a: (marks(*a)[0] % np.uint64(5), *marks(*a)[1:]))
    assert encoded_by(tokenizer, texts) == want


def test_vocabularies_with_other_rules_go_through_the_library():
    tokenizer = token_files.WordTokenizer(token_files.vocabulary_path("byte_bpe_50k.json"))
    texts = ["Some  TEXT here, don't.", "", "é 12345"]
    assert not tokenizer.fast and encoded_by(tokenizer, texts) == [[*tokenizer.whole.encode(t).ids, 1] for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_give_the_ids_back(kind):
    ids = np.random.default_rng(1).integers(0, 2**32, 70_001, dtype=np.uint32)
    blocks, planes, payload = token_files.encoded(ids, kind, block=1000)
    assert (token_files.decoded(blocks, planes, payload, kind) == ids).all()


def slow_fingerprint(text, words):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(parts[k : k + words]) for k in range(len(parts) - words + 1)] if len(parts) >= words else [" ".join(parts)] if parts else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fingers, radius):
    f = list(fingers)
    parent = list(range(len(f)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(f))]


def test_simhash_components(spark, docs, odd, empty):
    near = [(100 + k, " ".join(["same"] * 3 + [f"w{j}" for j in range(400)] + ["tail"] * k), "en", "s") for k in range(6)]
    rows = docs.select("doc_id", "text").limit(120).union(spark.createDataFrame([(1000 + r[0], r[1]) for r in near], "doc_id long, text string")).union(odd.select("doc_id", "text"))
    kept = pairs(rows)
    got = {}
    for r in simhash.near_duplicates(rows).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    fingers = [slow_fingerprint(t, 4) for _, t in kept]
    groups = slow_components(fingers, 4)
    least = {}
    for (doc_id, _), g in zip(kept, groups, strict=True):
        if doc_id is not None:
            least[g] = min(least.get(g, doc_id), doc_id)
    for (doc_id, _), f, g in zip(kept, fingers, groups, strict=True):
        assert (f"{f:016x}", least.get(g)) in got[doc_id]
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.without_near_duplicates(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {None, 1}


def slow_sets(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(parts[k : k + 5]) for k in range(len(parts) - 4)} or ({tuple(parts)} if parts else set())


def test_similar_documents(spark, docs, odd, empty):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(300)]
    copies = [" ".join(base)]
    for n in (1, 3, 5, 9, 20, 60):  # ever more words changed
        words = list(base)
        for k in rng.choice(300, n, replace=False):
            words[k] = f"x{k}"
        copies.append(" ".join(words))
    extra = spark.createDataFrame([(5000 + k, t) for k, t in enumerate(copies)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd.select(F.col("doc_id") + 20000, "text")).union(extra)
    kept = pairs(rows)
    sets = [slow_sets(t) for _, t in kept]
    parent = list(range(len(kept)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    got = {}
    for r in similar.similar_documents(rows).collect():
        got.setdefault(r["doc_id"], set()).add(r["first_key"])
    first = {}
    for k, (doc_id, text) in enumerate(kept):
        first.setdefault(root(k), min(got[doc_id]) if doc_id is not None else None)
        assert first[root(k)] in got[doc_id] or first[root(k)] is None
    assert len({x for v in got.values() for x in v}) == len({root(k) for k in range(len(kept))})
    assert similar.similar_documents(empty).count() == 0
    left = similar.without_similar(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {1, 7, 10}


def test_large_groups_of_near_copies_stay_together(spark):
    base = [f"w{k}" for k in range(400)]
    texts = [(k, " ".join([*base[: k + 20], f"y{k}", *base[k + 21 :]])) for k in range(150)]
    rows = similar.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len({r["first_key"] for r in rows}) == 1


def exact_groups(texts):
    """The groups of near-duplicates among texts, by comparing all pairs."""
    sets, parent = [slow_sets(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(texts))]


def assert_exact_groups(spark, texts):
    rows = similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r["first_key"] for r in rows}
    want = exact_groups(texts)
    assert len({(got[k], want[k]) for k in range(len(texts))}) == len(set(got.values())) == len(set(want))


def test_short_near_copies_are_all_found(spark):
    texts = []
    for k in range(80):
        words = [f"s{k}x{j}" for j in range(9 + k % 12)]
        texts += [" ".join(words), " ".join(words[:-1])]
    assert_exact_groups(spark, texts)


@pytest.mark.parametrize("similarity", [0.8, 0.75, 0.9])
def test_short_sets_are_linked_exactly(spark, similarity):
    """Sets of 1 to 13 hashes that share much: links connect all similar pairs of which one is short, and no link is less
    similar."""
    rng = np.random.default_rng(12)
    sets = set()
    for k in range(60):
        pool = rng.integers(0, 1 << 63, 13).astype(np.uint64)
        sets |= {tuple(np.sort(rng.choice(pool, int(rng.integers(max(1, 12 - k % 12), 14)), replace=False)).tolist()) for _ in range(12)}
    sets = sorted(sets)
    reach = similar.SHORT + similar.may_differ(similar.SHORT, similarity)
    rows = [(k, np.array(s, np.uint64).tobytes()) for k, s in enumerate(sets) if len(s) <= reach]
    links = [(r["a"], r["b"]) for r in similar.short_links(spark.createDataFrame(rows, "key long, hashes binary"), similarity).collect()]
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) >= similarity * len({*sets[a]} | {*sets[b]}) - 1e-9
    assert links and all(alike(a, b) for a, b in links)

    def groups(pairs):
        label = list(range(len(sets)))

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in pairs:
            label[root(a)] = root(b)
        return [root(k) for k in range(len(sets))]

    got = groups(links)
    short = [k for k, s in enumerate(sets) if len(s) <= similar.SHORT]
    assert all(got[a] == got[b] for a in short for b in range(len(sets)) if alike(a, b))


def test_recall_at_each_set_size(spark, monkeypatch):
    """Copies at the least similarity of texts of 4 to 40 shingles, in a layout for ten million sets."""
    layout = similar.Layout
    monkeypatch.setattr(similar, "Layout", lambda n, similarity: layout(10_000_000, similarity))
    texts, size = [], []
    for n in (4, 5, 6, 8, 9, 10, 12, 13, 16, 17, 24, 40):
        for k in range(60):
            words = [f"z{n}x{k}x{j}" for j in range(n + 4)]
            texts += [" ".join(words), " ".join([*words, *(f"y{n}x{k}x{j}" for j in range(similar.may_differ(n, 0.8)))])]
            size.append(n)
    got = {r["doc_id"]: r["first_key"] for r in similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {}
    for k, n in enumerate(size):
        found.setdefault(n, []).append(got[2 * k] == got[2 * k + 1])
    assert all(all(v) for n, v in found.items() if n <= similar.SHORT) and all(np.mean(v) >= 0.95 for v in found.values())
    assert len(set(got.values())) >= len(size)  # pairs of different texts stay apart


def test_large_groups_of_alike_texts_are_tried_in_full(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 16, raising=False)
    rng = np.random.default_rng(4)
    base, texts = [f"w{k}" for k in range(120)], []
    for k in range(120):  # pages of one template, in part with a copy that is nearer to them than they to each other
        words = [f"p{k}x{j}" if rng.random() < 0.03 else w for j, w in enumerate(base)]
        near = [f"q{k}x{j}" if rng.random() < 0.015 else w for j, w in enumerate(words)]
        texts += [" ".join(words), " ".join(near)]
    assert_exact_groups(spark, texts)


def test_recall_at_the_least_similarity(spark):
    """Pairs from 0.8 on, of the tables' documents and of made ones just above it, that end in one group; never more."""
    rng = np.random.default_rng(6)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("text").collect()]
    for k in range(300):  # a run of changed words costs as many shingles and four more
        words = [f"r{k}x{j}" for j in range(int(rng.integers(60, 300)))]
        n = len(words) - 4
        run = max(1, int(n * 0.2 / 1.8) - 4)
        at = int(rng.integers(4, n - run))
        texts += [" ".join(words), " ".join([*words[:at], *(f"r{k}y{j}" for j in range(run)), *words[at + run :]])]
    sets, holders, common = [slow_sets(t) for t in texts], {}, {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for some in holders.values():
        for j, b in enumerate(some):
            for a in some[:j]:
                common[a, b] = common.get((a, b), 0) + 1
    near = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    assert len(near) > 300
    got = {r["doc_id"]: r["first_key"] for r in similar.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.mean([got[a] == got[b] for a, b in near]) >= 0.98
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        parent[root(a)] = root(b)
    empty = {k for k, s in enumerate(sets) if not s}
    both = {(root(k), got[k]) for k in range(len(texts)) if k not in empty}
    assert len(both) == len({x for _, x in both})


@pytest.mark.parametrize("most", [simhash.BLOCK_PRINTS, 30])
def test_meeting_variants_link_all_that_are_near(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BLOCK_PRINTS", most)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    f = {int(x) for x in base}
    for x in base:
        for n in range(1, 7):
            y = int(x)
            for b in rng.choice(63, n, replace=False):
                y ^= 1 << int(b)
            f.add(y)
    f = sorted(f)
    found = simhash.links(spark.createDataFrame([(x,) for x in f], "f long")).collect()
    assert all((r["a"] ^ r["b"]).bit_count() <= 4 for r in found)
    parts = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(found)).collect()}
    groups = slow_components(f, 4)
    for i in range(len(f)):
        for j in range(i):
            assert (groups[i] == groups[j]) == (parts.get(f[i], f[i]) == parts.get(f[j], f[j]))


def test_slices_of_variants_hold_each_variant_once(monkeypatch):
    f = np.random.default_rng(8).integers(0, 2**63, 500).astype(np.uint64)
    whole = [np.concatenate(x) for x in zip(*simhash.variants_in(f, 3, 5, 64, 2), strict=True)]
    monkeypatch.setattr(simhash, "SLICE", 5000)
    parts = list(simhash.variants_in(f, 3, 5, 64, 2))
    assert len(parts) > 10 and sorted(zip(*(np.concatenate(x).tolist() for x in zip(*parts, strict=True)), strict=True)) == sorted(zip(*(x.tolist() for x in whole), strict=True))
    assert not set(parts[0][0].tolist()) & set(parts[1][0].tolist())


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(50)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[200 + k] == 200 for k in range(50))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))  # the smallest tables have 19 held-out labels
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.held_out == [zlib.crc32(str(x).encode()) % 5 == 0 for x in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.9
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    got = quality.score_quality(odd, labels).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    assert quality.score_quality(empty, labels).count() == 0
    none = labels.where("doc_id < 0")
    assert {r["score"] for r in quality.score_quality(odd, none).collect()} == {0.5}
    assert quality.keep_good(odd, none).columns == odd.columns and quality.keep_good(odd, none).count() == len(ODD)


def test_quality_model_against_plain_numpy(spark):
    """Summed normal equations, ridge weights and calibration; features against the Gaussian kernel they stand for."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.training_rows(quality.described(docs), labels)
    model, some = quality.train(rows), rows.toPandas()
    x, y, kept = np.array(some.stats.tolist(), np.float64), some.label.to_numpy(float), some.calibrate.to_numpy(bool)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.spread, x.std(0) + 1e-3)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-3), -5, 5)
    phi = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.project + model.phase), np.ones((len(z), 1))])
    t = phi[~kept]
    weights = np.linalg.solve(t.T @ t + np.diag([quality.RIDGE] * quality.FEATURES + [1e-6]), t.T @ y[~kept])
    assert np.allclose(model.weights, weights, atol=1e-6)
    k = np.clip(((phi[kept] @ weights + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    assert np.allclose(model.curve, quality.isotonic(np.bincount(k, y[kept], quality.BINS), np.bincount(k, minlength=quality.BINS)), atol=1e-6)
    scale = quality.KERNEL_WIDTH**2 * z.shape[1] / 8
    kernel = np.exp(-((z[:40, None] - z[None, :40]) ** 2).sum(2) / scale / 2)
    assert np.abs(phi[:40, :-1] @ phi[:40, :-1].T - kernel).mean() < 0.1


def test_isotonic_is_monotone_and_right_for_monotone_data():
    n = np.array([4.0, 0, 4, 4])
    assert np.allclose(quality.isotonic(np.array([1.0, 0, 2, 4]), n), [0.25, 0.375, 0.5, 1])
    assert (np.diff(quality.isotonic(np.array([4.0, 0, 1, 3]), n)) >= 0).all()


def test_license_base_counts(odd, docs, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for rows in (odd, docs):
        got = {}
        for r in licenses.scan_licenses(rows).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for doc_id, text in pairs(rows):
            words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            places, names = [], set()
            for phrase, label in licenses.PHRASES:
                p = phrase.split()
                here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
                places += here
                names |= {label} if here else set()
            want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(names)))
            assert want in [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[doc_id]]
            assert all(names <= set(r["labels"].split(",")) | {""} for r in got[doc_id] if r["base_labels"] == want[4])
    assert licenses.scan_licenses(empty).count() == 0


def test_license_templates():
    words = "this is released under the mit license of 2020".split()
    a = licenses.Automaton("mit", "<<optional>>released<<end>> under the <<optional>>terms of the<<end>> mit license")
    assert a.match(words, 2) == 5 and a.match(words, 3) == 4 and a.match(words, 0) == 0
    assert a.match("under the terms of the mit license".split(), 0) == 7
    assert a.match("under the terms of mit license".split(), 0) == 0
    b = licenses.Automaton("x", "copyright <<any:2>> all rights")
    assert b.match("copyright all rights".split(), 0) == 3 and b.match("copyright a b all rights".split(), 0) == 5 and b.match("copyright a b c all rights".split(), 0) == 0
    with pytest.raises(ValueError):
        licenses.Automaton("x", "<<optional>>a<<end>>")


def slow_lengths(parts, words, at):
    """All lengths of matches of template parts at a word, by trying everything."""
    if not parts:
        return {0}
    head, rest = parts[0], parts[1:]
    out = set()
    if isinstance(head, list):  # optional
        out |= slow_lengths(rest, words, at) | slow_lengths([*head, *rest], words, at)
    elif isinstance(head, int):  # up to so many words
        for n in range(min(head, len(words) - at) + 1):
            out |= {n + x for x in slow_lengths(rest, words, at + n)}
    elif at < len(words) and words[at] == head:
        out |= {1 + x for x in slow_lengths(rest, words, at + 1)}
    return out


def slow_parts(tokens):
    out = []
    while tokens:
        t = tokens.pop(0)
        if t == "<<end>>":
            break
        out.append(slow_parts(tokens) if t == "<<optional>>" else int(t[6:-2]) if t.startswith("<<any:") else t)
    return out


def test_license_automata_against_trying_everything():
    """Each template on texts made from it: with and without optional regions, with other words, with a word changed."""
    rng = np.random.default_rng(11)
    for label, template in [*licenses.TEMPLATES, ("x", "a <<optional>>b <<any:2>><<end>> <<optional>>c<<end>> d <<any:3>> d")]:
        tokens = re.findall(r"<<[a-z]+(?::\d+)?>>|[^\s<]+", template)
        parts = slow_parts(list(tokens))

        def made(parts):
            out = []
            for p in parts:
                out += ([] if rng.random() < 0.5 else made(p)) if isinstance(p, list) else [f"n{k}" for k in range(rng.integers(0, p + 2))] if isinstance(p, int) else [p]
            return out

        automaton = licenses.Automaton(label, template)
        for k in range(12):
            words = ["before", *made(parts), "d", "after"]
            if k % 3 == 2:
                words[rng.integers(1, len(words))] = "other"
            for at in range(min(3, len(words))):
                assert automaton.match(words, at) == max(slow_lengths(parts, words, at), default=0)


def test_whole_licenses_are_found(spark):
    texts = {label: re.sub(r"<<any:\d+>>", "Jane Doe", re.sub(r"<<optional>>|<<end>>", "", t)) for label, t in reversed(licenses.TEMPLATES)}
    rows = spark.createDataFrame([(k, f"Some file. {t.upper()}, and more", "en") for k, t in enumerate(texts.values())], "doc_id long, text string, labels string")
    got = {r["doc_id"]: (r["labels"].split(","), r["score"]) for r in licenses.scan_licenses(rows).collect()}
    for k, label in enumerate(texts):
        assert label in got[k][0] and got[k][1] == 1.0
    broken = spark.createDataFrame([(1, texts["bsd-3-clause"].replace("endorse", "praise"))], "doc_id long, text string")
    assert licenses.scan_licenses(broken).first()["labels"] == "bsd"


def test_url_filters(spark, small, duck):
    got, want = same_rows(url_filters.query(spark, small), duck, url_filters.ORACLE_SQL)
    assert got == want
    urls = [(1, None), (2, "no scheme"), (3, "http://WWW.Example.com/en/x?y#z"), (4, "https://a.net/es/1"), (5, "https://a.net"), (6, "http://example.com/en"), (7, "x://b.NET/fr/?q"), (7, "x://b.NET/fr/?q"), (None, "ftp://notexample.com/en/")]
    rows = [(r["page_id"], r["host"], r["path"], r["rule"]) for r in url_filters.judge_urls(spark.createDataFrame([(*u, "h", "p") for u in urls], "page_id long, url string, host string, rate string")).collect()]
    assert sorted(rows, key=str) == sorted(
        [
            (1, "", "", None), (2, "", "", None), (3, "www.example.com", "/en/x", "www.example.com/en/"), (4, "a.net", "/es/1", "net/es/"), (5, "a.net", "", None), (6, "example.com", "/en", "com/"),
            (7, "b.net", "/fr/", "net/fr/"), (7, "b.net", "/fr/", "net/fr/"), (None, "notexample.com", "/en/", "com/"),
        ],
        key=str,
    )
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_reputation_blocks_by_the_lower_bound(spark):
    rows = [("bad.example.org", True)] * 200 + [("good.example.com", False)] * 200 + [("new.example.org", None)] * 3
    got = {r["host"]: r for r in url_filters.host_reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["bad.example.org"]["lower"] > 0.9 and got["good.example.com"]["upper"] < 0.1
    assert got["new.example.org"]["domain"] == "example.org" and 0.5 < got["new.example.org"]["rate"] < 1


def test_pages_without_a_rule_fall_on_both_sides(spark):
    rows = [(f"good{i}.a.org", False) for i in range(5) for _ in range(40)] + [("bad.a.org", True)] * 40 + [(f"x{i}.spam.net", True) for i in range(4) for _ in range(30)] + [("y.fine.net", False)] * 50
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    urls = [(1, "http://bad.a.org/x"), (2, "http://good1.a.org/"), (3, "http://new.spam.net/"), (4, "http://new.fine.net/"), (5, "http://nobody.info/"), (6, None), (7, "http://a.example.net/es/")]
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), outcomes=outcomes).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block"}


def test_without_labelled_pages_all_are_allowed(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.info/")], "page_id long, url string")
    assert {(r["verdict"], r["rate"]) for r in url_filters.judge_urls(pages).collect()} == {("allow", 0.5)}


def slow_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "longest"), [(suffix_dedup.HOT, suffix_dedup.LONGEST), (2, 900), (1 / 64, 5000), (3, 70_000)])
def test_repeated_passages(spark, docs, odd, empty, hot, longest):
    """Common anchors cut into ranges (from 2 on) and into single windows (from 1 on), long texts in overlapping parts."""
    line = "a line that stands in very many texts with other words around, over sixty bytes"
    more = spark.createDataFrame([(9000 + k, f"{k * 7919} text {k} {line} and {k % 5} more {k * 31} words, so that it is long enough {k}") for k in range(60)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").limit(100).union(odd.select("doc_id", "text")).union(more)
    kept = pairs(rows)
    want = sorted(((d, *x) for (d, _), x in zip(kept, slow_repeats([t for _, t in kept], 100), strict=True)), key=str)
    got = sorted(map(tuple, suffix_dedup.repeats(rows, hot=hot, longest=longest).collect()), key=str)
    assert got == want
    assert suffix_dedup.repeats(empty, hot=hot).count() == 0


def test_runs_follow_the_bytes(spark):
    rows = [(k, "x" * (60_000 if 300 <= k < 330 else 10)) for k in range(2000)]
    cuts = common.by_id_ranges(spark.createDataFrame([*rows, (None, "y" * 70_000)], "doc_id long, text string"), "doc_id", "text", 100_000, 4)
    sizes = np.bincount(np.searchsorted(cuts, [k for k, _ in rows], "right"), [len(t) for _, t in rows])
    assert sizes.max() <= 200_000 and len(cuts) < 100 and cuts == sorted(set(cuts))


def test_runs_are_bounded_however_many_are_too_large(spark):
    rows = [(k, "x" * (2_000 if k % 3 == 0 else 1)) for k in range(-3_000, 6_000)] + [(7, "z" * 9_000)] * 3
    cuts = common.by_id_ranges(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), "doc_id", "text", 2_100, 2)
    sizes, run = np.zeros(len(cuts) + 1), np.searchsorted(cuts, [k for k, _ in rows], "right")
    np.add.at(sizes, run, [len(t) for _, t in rows])
    alone = sizes > 4_200
    assert len(cuts) > 1_000 and alone.sum() == 1 and {k for (k, _), r in zip(rows, run, strict=True) if alone[r]} == {7}
    assert common.by_id_ranges(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", 100, 4) == []


def test_rows_of_the_shuffle_hold_little_text(spark):
    rows = [(k // 2, f"{k} " * 400) for k in range(4_000)] + [(77, "z" * 3_000_000), (None, None), (78, "")]
    dealt = common.dealt_by_ranges(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id").collect()
    blocks = [pa.ipc.open_stream(r["block"]).read_all() for r in dealt]
    sizes = [sum(len(t or "") for t in b.column("text").to_pylist()) for b in blocks]
    assert all(n <= common.PIECE_BYTES or b.num_rows == 1 for n, b in zip(sizes, blocks, strict=True))
    assert len(blocks) < 30 + len({r["run"] for r in dealt})
    assert sorted((r for b in blocks for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text")), strict=True)), key=str) == sorted(rows, key=str)


def test_blocks_begin_with_groups_and_where_bytes_run_over():
    groups, sizes = np.array([0, 0, 0, 0, 2, 2, 3]), np.array([4, 6, 1, 30, 0, 0, 10])
    assert common.cut_by_bytes(groups, sizes, 10) == [0, 2, 3, 4, 6]
    assert common.cut_by_bytes(groups[:0], sizes[:0], 10) == []


def test_pieces_are_equal_by_bytes_not_by_hash():
    pool = np.frombuffer(b"abcabdabc", np.uint8)
    key, one, sizes, begin = np.zeros(3, np.uint64), np.zeros(3, np.uint64), np.full(3, 3), np.array([0, 3, 6])
    assert suffix_dedup.stand_earlier(key, one, sizes, begin, pool).tolist() == [False, False, True]


def test_cutting_keeps_columns_and_clean_texts(odd):
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.count() == len(ODD)
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in left.collect()}
    assert texts[10] == ("x", 1) and texts[9][0] == "" and texts[2] == ("", 0)


def test_suffix_order_with_a_difference_cover():
    rng = np.random.default_rng(5)
    for letters, n in ((2, 4000), (26, 3000), (1, 900)):
        text = rng.integers(97, 97 + letters, n).astype(np.uint8)
        text[n // 2 : n // 2 + 400] = text[:400]
        starts = np.arange(n - 100 + 1)
        order, group = suffixes.sorted_suffixes(text, np.full(n, n), starts)
        raw = text.tobytes()
        keys = [raw[s : s + 100] for s in order]
        assert keys == sorted(keys) and sorted(order) == list(starts)
        assert all((keys[k] == keys[k - 1]) == (group[k] == group[k - 1]) for k in range(1, len(keys)))


def test_leaks(spark, small, duck, empty, odd):
    got, want = same_rows(decontaminate.query(spark, small), duck, decontaminate.ORACLE_SQL)
    assert got == want and got
    question = "If Anna Smith buys 12 kg of apples and then sells 12 kg of pears to Bob Miller how much is left in the shop of Anna Smith today"
    other = question.replace("12", "57").replace("Anna Smith", "Mary Jones").replace("Bob Miller", "Tom Baker")
    broken = question.replace("12 kg of apples", "57 kg of apples").replace("Anna Smith", "Mary Jones", 1)
    texts = [(1, "Some words first. " + question + " and more."), (2, "In front: then " + other + " it ends."), (3, broken), (4, "nothing of the kind stands here at all, not a single word of it"), (5, None), (6, question[:40])]
    items = spark.createDataFrame([(7, question, "k"), (8, None, "k"), (9, "too short", "k"), (7, question, "k")], "item_id long, text string, words string")
    rows = decontaminate.leaks(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 7), (2, 7), (3, 7)}
    assert decontaminate.leaks(empty, items).count() == 0 and decontaminate.leaks(odd, items.where("false")).count() == 0
    assert decontaminate.without_leaks(odd, items).columns == odd.columns


def test_numbers_with_any_sign_match_the_sql(spark):
    import duckdb
    import pandas as pd

    question = "if a ticket costs €57 and a meal costs £12 euros or 7 (kg) of rice what do they cost per person on this trip"
    other = question.replace("57", "81").replace("12", "33").replace("7 (kg)", "9 (lbs)")
    tables = {"documents": pd.DataFrame([(1, other), (2, question), (3, "€ £ €x £5 €6%) nothing of the kind")], columns=["doc_id", "text"]), "benchmark": pd.DataFrame([(7, question)], columns=["item_id", "text"])}
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    got, want = same_rows(decontaminate.leaks(*(spark.createDataFrame(t) for t in tables.values())), con, decontaminate.ORACLE_SQL)
    assert got == want and len(got) == 2


def duck_of(**tables):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.register(name, pd.DataFrame(rows, columns=columns))
    return con


def test_leaks_that_templates_alone_would_miss(spark):
    """Conflicts after a long agreement, items of placeholders, other case, short items, joined names, glued units."""
    long = "the old bridge by the mill was built in 1712 and has been widened at both ends since then so carts from the north can cross it while others wait until 1712 is read aloud"
    numbers = "4 8 15 16 23 42 108 7 9 11 12 13 14 99"
    names = "then Anna Marie Smith gave exactly 12 kg of ripe apples to Bob and Anna Marie Smith kept the rest for a long winter"
    items = [(1, long), (2, numbers), (3, names), (4, "which river runs through Prague"), (5, "two words"), (6, "what is 3 kg plus 4 kg")]
    docs = [
        (1, long.replace("until 1712", "until 1815")), (2, "codes: " + numbers + " end"), (3, long.upper()), (4, names.replace("Anna Marie Smith", "Eva").replace("12 kg", "55kg")),
        (5, "Quiz: which river runs through prague?"), (6, "two words"), (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"), (8, names.replace("Smith kept", "Jones kept").replace("to Bob", "to Tom")),
        (9, "what is 3 kg plus 5 kg"), (10, "a clean text about rivers and bridges which were built in 1712 by many hands"), (None, long), (11, None), (12, ""),
    ]
    con = duck_of(documents=([d for d in docs if d[0] is not None], ["doc_id", "text"]), benchmark=(items, ["item_id", "text"]))
    df = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]) for r in df.collect()}
    assert rows == {(1, 1), (2, 2), (3, 1), (4, 3), (5, 4), (8, 3), (None, 1)}
    got, want = same_rows(df.where("doc_id IS NOT NULL"), con, decontaminate.ORACLE_SQL)
    assert got == want


def test_large_benchmarks_are_shuffled(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontaminate.leaks(docs, items).collect())) == want


def test_packing(docs, odd, empty):
    for rows in (docs, odd):
        packed = packing.pack(rows, capacity=300, shard_pieces=64).toPandas()
        texts = rows.toPandas()
        words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts.text)
        assert packed.n_words.sum() == words and packed.n_words.max() <= 300
        assert len(packed) == sum(max(1, -(-len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) // 300)) for t in texts.text)
        assert packed.groupby("bin_id").n_words.sum().max() <= 300
        assert (packed.groupby("bin_id").n_words.sum() == packed.groupby("bin_id").bin_used.first()).all()
        assert packed.dropna(subset=["source"]).groupby(["bin_id", "source"]).size().max() == 1
        for _, b in packed.sort_values(["bin_id", "bin_offset", "n_words"]).groupby("bin_id"):
            spans = sorted((o, o + n) for o, n in zip(b.bin_offset, b.n_words, strict=True))
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert packing.pack(empty).count() == 0


def test_near_copies_and_long_texts_in_bins(spark):
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words, *["end"] * (k % 3)]), f"s{k}") for k in range(12)] + [(100, " ".join(f"x{k}" for k in range(9000)), None), (101, "", "a"), (102, None, None)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=300, shard_pieces=8).toPandas()
    fingers = {k: slow_fingerprint(t, 4) for k, t, _ in rows}
    groups = dict(zip(fingers, slow_components(fingers.values(), 4), strict=True))
    some = packed[packed.n_words > 0]
    assert some.assign(g=some.doc_id.map(groups)).groupby(["bin_id", "g"]).size().max() == 1
    assert len(packed[packed.doc_id == 100]) == 30 and len(packed) == 44 and packed.bin_id.map(lambda x: x >> 32).nunique() > 3


def test_best_fit_takes_the_tightest_compatible_bin():
    placed = packing.best_fit([6, 5, 4, 3, 2], ["a", "b", "a", "c", "a"], [1, 2, 3, 3, 4], 10)
    assert placed == [(0, 0), (1, 0), (1, 5), (0, 6), (2, 0)]
    rng = np.random.default_rng(2)
    lengths = sorted(rng.integers(1, 50, 300).tolist(), reverse=True)
    sources, clusters = rng.integers(0, 5, 300).tolist(), rng.integers(0, 200, 300).tolist()
    bins = []
    for (b, at), n, s, c in zip(packing.best_fit(lengths, sources, clusters, 100), lengths, sources, clusters, strict=True):
        fits = [(100 - x[0], k) for k, x in enumerate(bins) if x[0] + n <= 100 and s not in x[1] and c not in x[2]]
        assert (100 - bins[b][0] == min(fits)[0] and at == bins[b][0]) if fits else (b == len(bins) and at == 0)
        if not fits:
            bins.append([0, set(), set()])
        bins[b][0] += n
        bins[b][1].add(s)
        bins[b][2].add(c)


def test_canonical_fingerprints(docs, odd, empty):
    for rows in (docs, odd):
        kept = pairs(rows)
        got = {}
        for r in fingerprints.compare_with_edits(rows).collect():
            got.setdefault(r["doc_id"], []).append(r)
        for k, (doc_id, text) in enumerate(kept):
            text, follower = text or "", kept[(k + 1) % len(kept)][1] or ""
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            same = lambda a, b: float(fingerprints.canonical(a) == fingerprints.canonical(b))
            want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.digest(fingerprints.canonical(text)), same(text, edited), same(text, follower))
            assert want in [(r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got[doc_id]]
    assert fingerprints.compare_with_edits(empty).count() == 0


def test_edited_texts_that_share_a_fingerprint_are_told_apart(spark):
    columns = "doc_id long, fingerprint string, edited_fingerprint string, canon_sha256 string, canon_edited_sha256 string"
    rows = spark.createDataFrame([(1, "f", "g", "a", "b"), (2, "g", "h", "c", "d"), (3, "k", "k", "e", "e")], columns)
    got = {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"]) for r in fingerprints.told_apart(rows, spark.createDataFrame([], "fingerprint string")).collect()}
    assert got == {1: ("f", "g-b"), 2: ("g-c", "h"), 3: ("k", "k")}


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    assert fingerprints.canonical("Ｆoo  BAR\n") == b"foo bar"
    rows = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b")], "doc_id long, text string")
    prints = spark.createDataFrame([(1, "same"), (2, "same"), (3, "same")], "doc_id long, fingerprint string")

    def colliding(batches):
        import pyarrow as pa

        for b in batches:
            canon = [fingerprints.canonical(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["same"] * len(canon)), pa.array(canon, pa.binary())], names=["doc_id", "fingerprint", "canon"])

    monkeypatch.setattr(fingerprints, "canonical_rows", colliding)
    own = {r["doc_id"]: r["own"] for r in fingerprints.collisions(rows, prints).collect()}
    assert own[1] == own[2] != own[3]
