"""Operators on documents: language (3), packing (5), decontamination (8), sharding (9), licences (10)."""

import zlib
from collections import Counter, defaultdict

import edge_cases
import numpy as np
import parity
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwork.llm import decontam, langid, license_scan, packing, sharding
from gridwork.llm.queries import QUERIES, TOKENIZER

EDGES = len(edge_cases.TEXTS)


@pytest.fixture(scope="module")
def edges(spark):
    return edge_cases.documents(spark).cache()


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{parity.SMALL}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language"](spark, parity.SMALL)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == truth.count()
    rows = got.filter("held_out").join(truth, "doc_id").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_text_vector_against_its_definition():
    text = "Ab c, dé"
    letters = [0, *(ord(c) % (langid.LETTERS - 1) + 1 if c.isalpha() else 0 for c in "ab c dé"), 0]
    signs = langid._placed_letters()[-1]
    wanted = np.zeros(langid.DIMENSIONS)
    for i in range(len(letters) - 2):
        a, b, c = (signs[x].astype(int) for x in letters[i:i + 3])
        wanted += np.roll(a, 2) * np.roll(b, 1) * c
    assert (langid.text_vectors([text, None, ""])[0] == wanted).all()
    assert not langid.text_vectors([None]).any()


@pytest.mark.parametrize("texts", [
    ["abc abd"] * 200 + ["xyz", None, ""], ["".join(chr(0x4E00 + (i * 37 + j * j) % 20_000) for j in range(60)) for i in range(300)],
    ["".join(chr(0x4E00 + (j * j + j // 7) % 20_000) for j in range(30_000)), "ab ab ab"], [None], []])
def test_text_vectors_in_blocks(texts, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50)
    monkeypatch.setattr(langid, "TABLE", 600)
    got = langid.text_vectors(texts)
    for text, vector in zip(texts, got, strict=True):
        grams, counts = langid.gram_counts(text)
        assert (vector == (langid.gram_vectors(grams) * counts[:, None]).sum(axis=0) if len(grams) else vector == 0).all()


def test_languages_by_hand(spark):
    """The whole result at sf0.001 from the contract's definition, one text at a time."""
    docs = spark.read.parquet(f"{parity.SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in docs}
    vector = {}
    for r in docs:
        grams, counts = langid.gram_counts(r["text"])
        vector[r["doc_id"]] = sum((v * float(c) for v, c in zip(langid.gram_vectors(grams), counts, strict=True)) if len(grams) else (),
                                  np.zeros(langid.DIMENSIONS))
    sums = {}
    for r in docs:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vector[r["doc_id"]]
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    mean = sum(unit.values()) / len(unit)
    unit = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in unit.items()}
    got = {r["doc_id"]: r for r in QUERIES["op3_language"](spark, parity.SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (own["lang_pred"], own["score"]) == ("und", 0)
            continue
        v = vector[r["doc_id"]] / np.linalg.norm(vector[r["doc_id"]]) - mean
        cosine = {k: float(v @ p / np.linalg.norm(v)) for k, p in unit.items()}
        assert own["lang_pred"] == max(sorted(cosine), key=cosine.get) and abs(own["score"] - max(cosine.values())) < 1e-9
        assert own["held_out"] == held[r["doc_id"]]


def test_language_edges(spark, edges):
    got = defaultdict(list)
    for r in langid.identify(edges).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == EDGES
    for i in (2, 3, 4, 5):
        assert got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0
    assert got[1][0] == got[1][1] and got[6][0]["lang_pred"] == "en"
    assert langid.identify(edge_cases.empty(spark, edges)).count() == 0
    unlearnt = langid.identify(edges.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlearnt} == {"und"}
    kept = langid.keep_identified(edges)
    assert kept.columns == edges.columns and {2, 3, 4, 5}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_texts_in_no_learnt_language_go(spark):
    docs = spark.read.parquet(f"{parity.SMALL}/documents.parquet")
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    finnish = ("Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
               "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.")
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
    random = " ".join("".join(rng.choice(letters, rng.integers(2, 10))) for _ in range(80))
    base64 = "".join(rng.choice(letters + [x.upper() for x in letters] + list("0123456789+/"), 600))
    strange = {10 ** 9 + i: t for i, t in enumerate([finnish, russian, random, base64])}
    added = spark.createDataFrame([(i, t) for i, t in strange.items()], "doc_id long, text string")
    kept = [r["doc_id"] for r in langid.keep_identified(docs.unionByName(added, allowMissingColumns=True)).collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in docs.collect())
    # a language that is not learnt, and the same one learnt
    unlearnt = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    german = {r["doc_id"] for r in docs.filter("lang = 'de'").collect()}
    stay = {r["doc_id"] for r in langid.keep_identified(unlearnt).collect()}
    assert german and len(german & stay) < 0.1 * len(german)
    assert {r["doc_id"] for r in docs.collect()} - german <= stay


def _pieces(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
    for at in range(0, len(ids), packing.SEQUENCE):
        own = np.array(ids[at:at + packing.SEQUENCE], "<u4")
        yield at // packing.SEQUENCE, at, len(own), zlib.crc32(own.tobytes())


def _check_packed(rows):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    return len(by_sequence)


def test_pieces_are_the_tokenizers(spark, edges):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    wanted = Counter((i, *p) for i, t, _ in edge_cases.TEXTS for p in _pieces(t, tokenizer))
    rows = packing.pack(edges, TOKENIZER).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    _check_packed(rows)
    assert packing.pack(edge_cases.empty(spark, edges), TOKENIZER).count() == 0


def test_packing_documents_is_tight(spark):
    rows = QUERIES["op5_pack_documents"](spark, parity.SMALL).collect()
    assert _check_packed(rows) <= 1.02 * sum(r["length"] for r in rows) / packing.SEQUENCE + 1


@pytest.mark.parametrize("lengths", [
    [], [2048] * 5, [1], [1024] * 9, [700] * 100, [1500] * 4 + [548] * 2 + [274] * 4,
    np.random.default_rng(5).integers(1, 2049, 3000).tolist(), np.random.default_rng(6).integers(1, 300, 3000).tolist()])
def test_plan_places_every_piece_once(lengths):
    counts = Counter(lengths)
    plan, sequences = packing.plan(counts)
    rows = []
    for length, n in counts.items():
        own = plan[plan[:, 0] == length]
        for number in range(n):
            _, first, sequence, offset = own[np.searchsorted(own[:, 1], number, "right") - 1]
            rows.append({"sequence_id": sequence + number - first, "offset": offset, "length": length})
    assert _check_packed(rows) == sequences
    long = sum(x > packing.SEQUENCE / 2 for x in lengths)
    assert sequences <= 1.1 * max(long, sum(lengths) / packing.SEQUENCE) + 1 or lengths[:1] == [700]


def test_fit_reaches_an_exact_solution():
    patterns = np.array([[1500, 548, 0, 0], [1024, 1024, 0, 0], [1000, 524, 524, 0]])
    counts = np.zeros(packing.SEQUENCE + 1, int)
    for p, n in zip(patterns, (30, 12, 7), strict=True):
        np.add.at(counts, p[p > 0], n)
    assert np.allclose(packing.fit_counts(patterns, counts), (30, 12, 7), atol=0.1)


def test_contained_items_query(spark):
    assert parity.check(spark, "op8_contained_items")


def test_contained_items_edges(spark, edges):
    rows = [(1, "seven wizards watch from afar the quick brown"), (1, "seven wizards watch from afar the quick brown"),
            (2, "ONE, two!"), (3, None), (4, ""), (5, "wizards one"), (None, "about nothing at all"),
            (6, "quick brown fox jumps over the lazy dog while seven wizards watch from near " * 3)]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.contained_items(edges, items).collect())
    assert got == {(6, 1): 2, (8, 2): 1, (None, None): 1}
    assert decontam.contained_items(edges, items.limit(0)).count() == 0
    assert decontam.contained_items(edge_cases.empty(spark, edges), items).count() == 0
    kept = decontam.clean(edges, items)
    assert kept.columns == edges.columns and {6, 8}.isdisjoint({r["doc_id"] for r in kept.collect()})
    assert kept.count() == EDGES - 2


def test_candidates_miss_no_item_of_least_containment():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    for n in (6, 12, 40, 200):
        item = rng.choice(words, n, replace=False).tolist()
        index = decontam.ItemIndex([(1, " ".join(item))])
        for _ in range(30):
            wanted = decontam.shingles(item, 5)
            copy = list(item)
            for at in rng.integers(0, n, max(1, n // 40)):
                copy[at] = "changed"
            text = " ".join(rng.choice(words, 2000).tolist() + copy + rng.choice(words, 2000).tolist())
            shared = len(wanted & decontam.shingles(text.split(), 5))
            assert bool(index.matches(text)) == (shared >= decontam.LEAST * len(wanted))


def test_sharding_query(spark):
    parity.check(spark, "op9_shard_documents")


def test_table_is_filled_in_turns_by_preference():
    names, size = ["a", "b", "c", "d", "e"], 101
    owner = sharding.fill_table(names, size)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    number = sharding._number
    lists = [[(number(f"start {s}") + j * (number(f"step {s}") % (size - 1) + 1)) % size for j in range(size)] for s in names]
    assert all(sorted(x) == list(range(size)) for x in lists)
    free, wanted = set(range(size)), [None] * size
    while free:
        for who, preference in enumerate(lists):
            if free:
                slot = next(s for s in preference if s in free)
                free.remove(slot)
                wanted[slot] = who
    assert owner == wanted


def test_few_slots_move_when_a_shard_goes():
    names, size = [f"s{i}" for i in range(20)], 4099
    before, after = sharding.fill_table(names, size), sharding.fill_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.1 * size
    with pytest.raises(ValueError):
        sharding.fill_table(names, 100)
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 101)


def test_sharding_edges(spark, edges):
    placed = sharding.place(edges, "doc_id", ["x", "y"], 11)
    rows = placed.collect()
    assert len(rows) == EDGES and {r["shard"] for r in rows} <= {"x", "y"}
    assert len({r["slot"] for r in rows if r["doc_id"] == 1}) == 1 and set(placed.columns) == set(edges.columns)
    assert sharding.place(edge_cases.empty(spark, edges), "doc_id", ["x"], 2).count() == 0


def test_license_query(spark):
    parity.check(spark, "op10_licenses")


def test_license_edges(spark, edges):
    rows = license_scan.scan(edges).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == EDGES and got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["score"] == 0
    r = got[10]
    assert (r["n_base"], r["first_word"], r["last_word"]) == (3, 3, 14)
    assert r["base_labels"] == "cc-by,mit" and r["labels"] == "cc-by,cc-by-nc,mit" and r["score"] == 1
    assert got[6]["n_words"] == 15 * 4000
    assert license_scan.scan(edge_cases.empty(spark, edges)).count() == 0


def test_notice_with_changed_words(spark):
    notice = license_scan.NOTICES[0][0].split()
    text = " ".join(["before"] * 50 + notice[:9] + ["really"] + notice[9:] + ["after"])
    short = " ".join(notice[:9])
    docs = spark.createDataFrame([(1, text), (2, short), (3, "MIT-License"), (4, "mit x license cc by")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert got[1]["labels"] == "mit" and got[1]["base_labels"] == "" and got[1]["n_base"] == 0 and 0.8 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and 0 < got[2]["score"] < 0.8
    assert got[3]["labels"] == "mit" and got[4]["labels"] == "" and got[4]["n_words"] == 4
