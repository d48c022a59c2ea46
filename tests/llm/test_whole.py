"""Cases in which operators once did less than the whole job."""

import random
import string

import numpy as np
import pytest

from quarryline.llm import bpe, pii, secrets, simhash, spans
from quarryline.llm.common import tokenizer_path


def test_encoder_on_pieces_of_many_ids():
    random.seed(9)
    e = bpe.encoder(tokenizer_path())
    texts = ["".join(random.choices("ACGTéж漢", k=120_000)), "a b", "\t\n" * 70_000]
    ids, counts = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert min(len(want[0]), len(want[2])) > 1 << 16
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


def test_keep_one_of_each_group(spark):
    texts = ["red green blue one", "seven small cats sleep here", "an old stone bridge over water", "what the clerk wrote in May"]
    given = [(None, texts[0]), (None, texts[1]), (None, texts[0]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (7, texts[3]), (None, texts[3]), (9, None), (8, " ")]
    rows = spark.createDataFrame([(i, t, "en", "s", n, "x") for n, (i, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long, words string")
    kept = simhash.keep_one(rows.unionByName(rows)).collect()
    assert kept[0].words == "x" and sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept) == sorted([(-1, texts[0]), (-1, texts[1]), (5, texts[2]), (5, texts[3]), (8, " ")])
    assert all(given[r.n_chars] == (r.doc_id, r.text) for r in kept)


def variants(seed, n, changes, again):
    """Changed forms of one text, and of each a changed copy: few are similar to others, most share fingerprints."""
    random.seed(seed)
    word = lambda: "".join(random.choices("abcdefghij", k=5))
    original, texts = [word() for _ in range(120)], []
    for _ in range(n):
        text = list(original)
        for i in random.sample(range(120), changes):
            text[i] = word()
        copy = list(text)
        for i in random.sample(range(120), again):
            copy[i] = word()
        texts += [" ".join(text), " ".join(copy)]
    return texts


def roots(sets, similarity=0.8):
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    forest = simhash.Forest(len(sets))
    forest.join(*np.array(pairs, np.int64).reshape(-1, 2).T)
    return forest.root.tolist()


@pytest.mark.parametrize("small", [False, True])
def test_keep_one_links_all_similar_texts(spark, monkeypatch, small):
    if small:  # several shards, and clusters cut in blocks
        monkeypatch.setattr(simhash, "FIRST", 2000)
        monkeypatch.setattr(simhash, "BLOCK_TEXTS", 100)
    texts = variants(3, 200, 2, 2)
    words = [t.split() for t in texts]
    want = roots([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words])
    assert 50 < len(set(want)) < 100
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_without_any_fingerprint_in_common(spark, monkeypatch):
    monkeypatch.setattr(simhash, "similar_pairs", lambda texts, similarity: spark.createDataFrame([], "a long, b long"))
    text = [f"w{i}" for i in range(60)]
    texts = [" ".join(text), " ".join(text[:50]), " ".join(text[:42]), " ".join(text[:30]), "a b", "b a", None, "x " * 9, "x " * 12, "q " + " ".join(text[5:])]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 4, 5, 6, 7]


def test_sets_of_a_cluster():
    rng = np.random.default_rng(4)
    for trial in range(60):
        sets = [np.unique(rng.integers(0, 12, rng.integers(1, 14)).astype(np.uint64) * np.uint64(1 << 59)) for _ in range(30)]
        sets += [np.setdiff1d(np.arange(k, k + 40, dtype=np.uint64), rng.integers(0, 60, 5).astype(np.uint64)) for k in rng.integers(0, 12, 30)]
        similarity = [0.8, 0.5, 0.9, 1.0][trial % 4]
        want = roots([set(x.tolist()) for x in sets], similarity)
        known = np.where(rng.random(60) < 0.5, want, np.arange(60)) if trial % 2 else np.arange(60)
        forest, block = simhash.Forest(60), rng.integers(0, 3, 60)
        forest.join(np.arange(60), known)
        given = forest.root.copy()
        for i in range(3):
            for j in range(i, 3):
                which = np.flatnonzero((block == i) | (block == j))
                a, b = simhash.link_sets([sets[x] for x in which], given[which], block[which] if i != j else None, similarity)
                forest.join(which[a], which[b])
        assert forest.root.tolist() == want
        a, b = simhash.link_sets(sets, given, None, similarity)
        forest = simhash.Forest(60)
        forest.join(np.arange(60), given)
        forest.join(a, b)
        assert forest.root.tolist() == want


def test_possible_pairs():
    rng = np.random.default_rng(6)
    for n in (20, 90, 200, 700):
        base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        sets = [np.unique(rng.choice(base[: n + n // 10], int(rng.integers(n * 3 // 4, n)), replace=False)) for _ in range(40)]
        sets += [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(40)]  # unlike all
        odd = [simhash.parities(x) for x in sets]
        x, y = np.triu_indices(80, 1)
        apart = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
        bound = simhash.Parities(odd).apart(x, y)
        assert (bound <= apart).all() and bound.any()
        size = np.array([len(s) for s in sets])
        a, b = simhash.possible(np.zeros(80, np.int64), np.arange(80), np.arange(80), size, odd, 0.8)
        forest = simhash.Forest(80)
        forest.join(a, b)
        assert all(forest.root[i] == forest.root[j] for i in range(80) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])))
        assert forest.root[40:].tolist() == list(range(40, 80))


def chance(seed, n):
    random.seed(seed)
    return "".join(random.choices(string.ascii_letters + string.digits, k=n))


def test_secrets_whole():
    for token in (chance(1, 1000), ".".join([chance(2, 36), chance(3, 150), chance(4, 43)]), chance(5, 30) + "." + chance(6, 5) + "." + chance(7, 27)):
        text = "Authorization: Bearer " + token + " ok"
        assert secrets.find(text) == [("novel", 22, 22 + len(token))]
        assert secrets.find("bearer " + "x " * 30 + token) == []  # out of every cue's reach


def test_secrets_repeated():
    for n in (40, 300):
        token = chance(n, n)
        text = "".join(f"retry {i} bearer {token}\n" for i in range(5)) + f"bearer id={token}"
        assert token not in spans.redacted(text, secrets.find(text)) and len(secrets.find(text)) == 6
    assert secrets.find("access the file_name_of_the_config of the application and access the file_name_of_the_config") == []


def test_pii_long_passwords_and_ibans_before_words():
    for user, password in (("u", "p" * 129), ("u" * 65, "p"), ("u" * 5000, "p" * 5000)):
        url = f"https://{user}:{password}@db.example"
        assert [x for x in pii.find(f"see {url} now") if x[0] == "url"] == [("url", 4, 4 + len(url))]
    for iban in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"):
        for after in ("", " BIC COBADEFF", " and", " A B C", ", X"):
            assert [x for x in pii.find(f"IBAN: {iban}{after}") if x[0] == "iban"] == [("iban", 6, 6 + len(iban))]
    assert pii.find("IBAN: DE89 3704 0044 0532 0130 01 BIC") == []
