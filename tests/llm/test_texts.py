"""N-gram join, substring dedup, packing, SentencePiece and toxicity against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import ngram_join, packing, substring, toxicity, wordhash
from graphloom.llm import sentencepiece_viterbi as sentencepiece

KIND = "doc_id long, text string, n_words int, component_id string, score string"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], KIND)


def corpus(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = [r.choice(words) for _ in range(60)]
    rows, base = [], [r.choice(words) for _ in range(120)]
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = [r.choice(words) for _ in range(r.randint(1, 150))]
        elif kind == 1:
            w = [r.choice(words) if r.random() < r.choice([0, 0.01, 0.03, 0.06]) else x for x in base]
        elif kind == 2:
            w = [r.choice(words) for _ in range(20)] + passage[r.randint(0, 20) :] + [r.choice(words) for _ in range(20)]
        else:
            w = rows[r.randrange(len(rows))][1].split()
        rows.append((i, "  ".join(w) if i % 5 else "\n".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE two"), (n + 5, "one"), (n + 6, "a " * 9000), (n + 7, "a " * 8999), (3, rows[3][1])]


def jaccard_truth(rows):
    sets = []
    for _, t in rows:
        w = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("pairs_up_to, tied_here, block, fragments", [(128, 32, 256, 4), (4, 3, 8, 4), (1, 2, 4, 1), (1000, 1000, 64, 9)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, pairs_up_to, tied_here, block, fragments):
    """Ties, pairs, blocks and fragments of several sizes."""
    for name, value in (("PAIRS_UP_TO", pairs_up_to), ("TIED_HERE", tied_here), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", fragments)
    try:
        rows = corpus(5, 160)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(make(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == jaccard_truth(rows)


def test_heavy_ngrams_are_tied_where_they_lie(spark, monkeypatch):
    """Every n-gram counts as frequent: holders that stand together are tied in their portion."""
    monkeypatch.setattr(ngram_join, "_heavy", lambda facts: np.ones(ngram_join.WIDTH, bool))
    monkeypatch.setattr(ngram_join, "TIED_HERE", 2)
    rows = corpus(7, 120)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(make(spark, rows)).collect())
    assert got == jaccard_truth(rows)


def test_portions_hold_whole_texts():
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 20, "c" * 4, "d" * 4])], names=["i", "text"])
    for most in (1, 5, 8, 9, 100):
        parts = list(wordhash.portions(b, 1, most))
        assert pa.Table.from_batches(parts).combine_chunks() == pa.Table.from_batches([b])
        assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= most for p in parts)


def repeats_truth(rows, length):
    words = [BLANK.findall(t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for s in range(len(w) - length + 1):
            seen.setdefault(tuple(w[s : s + length]), []).append((k, s))
    gone = [set() for _ in rows]
    for at in seen.values():
        if len(at) > 1:
            for k, s in at:
                gone[k].update(range(s, s + length))
    return sorted((i, len(w), len(gone[k]), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone[k]).encode()).hexdigest()) for k, ((i, _), w) in enumerate(zip(rows, words)))


@pytest.mark.parametrize("length", [35, 12, 3])
def test_substring_dedup_against_brute_force(spark, length):
    rows = [(i, t) for i, t in corpus(9, 120, 60) if i < 126]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.drop_repeats(make(spark, rows), length, digest=True).collect())
    assert got == repeats_truth(rows, length)


def test_equal_windows_pick_the_same_seed_wherever_they_stand():
    r = np.random.default_rng(6)
    words = r.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 5, 28):
        at = substring.least_last(words, width)
        assert at.tolist() == [max(range(i, i + width), key=lambda j: (-int(words[j]), j)) for i in range(len(words) - width + 1)]


def test_rows_alike_in_id_and_text_repeat_each_other(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text)] * 30 + [(2, "own " + text + " words"), (3, "other words")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.drop_repeats(make(spark, rows)).collect())
    assert got == [(1, 50, 50)] * 30 + [(2, 52, 50), (3, 2, 0)]


def test_substring_dedup_keeps_columns_and_clean_texts(spark):
    rows = [(1, "a  b\n" + "x y z " * 3), (2, "clean   text"), (3, None)]
    got = {r.doc_id: r for r in substring.drop_repeats(make(spark, rows), 4, keep=True).collect()}
    assert got[2].text == "clean   text" and got[2].component_id == "clash" and got[3].text is None
    assert got[1].n_removed == 9 and got[1].text == "a b"


def test_empty_tables(spark, vocab):
    none = make(spark, [])
    assert ngram_join.jaccard_components(none).count() == 0
    assert substring.drop_repeats(none).count() == 0
    assert packing.pack(none, vocab("byte_bpe_50k.json")).count() == 0
    assert sentencepiece.encode_texts(none, vocab("piece_bpe_32k.model")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_packing_places_every_id_once_without_gaps(spark, vocab):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    rows = corpus(3, 60) + [(900, "<|endoftext|> and " * 3), (901, "é" * 5000)]
    df = make(spark, rows)
    got = packing.pack(df, vocab("byte_bpe_50k.json"), vocab("byte_bpe_50k.tiktoken"), length=64, shard=16, with_ids=True).collect()
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 0] for _, x in rows)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    made, by_doc = {}, {}
    for r in got:
        made.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in made.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(sum(r.length for r in p) < 64 for p in made.values()) <= 4  # one short sequence for each partition
    ids = []
    for (_, n), pieces in by_doc.items():
        places = sorted(pieces, key=lambda r: r.start)
        if sum(r.length for r in places) == n:  # repeated rows share a key and are left to the sum below
            ids.append([x for r in places for x in r.ids])
            assert [r.start for r in places] == np.cumsum([0, *[r.length for r in places]])[:-1].tolist()
    assert all(i in want for i in ids) and sum(map(len, want)) == sum(r.length for r in got)


def test_bm25_against_its_formula():
    r = np.random.default_rng(5)
    units = [r.integers(0, 40, r.integers(1, 60)) for _ in range(30)]
    index, mean = packing.Index(units), np.mean([len(u) for u in units])
    for seed in units:
        score = []
        for u in units:
            total = 0.0
            for t in set(seed.tolist()):
                tf, df = int((u == t).sum()), sum(t in x for x in units)
                total += np.log(1 + (30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / mean))
            score.append(total)
        order = index.neighbours(seed)
        assert np.allclose(np.array(score)[order], np.sort(score)[::-1])


def test_related_documents_meet_from_anywhere(spark, vocab):
    """Documents of one subject that lie in different partitions are packed together."""
    r = random.Random(11)
    subjects = [[f"{a}{b}" for a in x for b in ("ology", "ographer", "ometric")] for x in (("zephyr", "quartz"), ("basalt", "plankton"), ("volcan", "marsupial"), ("origami", "samovar"))]
    rows = [(i, " ".join(r.choice(subjects[i % 4]) for _ in range(60))) for i in range(80)]
    got = packing.pack(make(spark, rows).repartition(7), vocab("byte_bpe_50k.json"), vocab("byte_bpe_50k.tiktoken")).collect()
    windows = {}
    for p in got:
        windows.setdefault(p.sequence_id, []).append(p)
    pure = sum(max(sum(p.length for p in w if p.doc_id % 4 == k) for k in range(4)) for w in windows.values()) / sum(p.length for p in got)
    assert pure > 0.7
    assert packing.marks(np.array([], np.int64)) == (-1, -1) and packing.marks(np.array([7, 7])) == (7, -1)


def test_packing_keeps_columns_whose_names_do_not_clash(spark, vocab):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, None, 6, "y")], "doc_id long, text string, offset int, lang string")
    got = packing.pack(docs, vocab("byte_bpe_50k.json"), keep=True)
    assert got.columns == ["doc_id", "text", "lang", *(c.split()[0] for c in packing.PIECES.split(", "))]
    assert sorted((r.text or "", r.lang, r.doc_tokens) for r in got.collect())[0] == ("", "y", 1)


def test_windows_prefer_related_units():
    r = np.random.default_rng(1)
    topics = [r.integers(k * 1000, k * 1000 + 50, size=(8, 30)) for k in range(4)]
    units = [u for k in range(8) for u in (topics[t][k] for t in range(4))]
    windows, rest = packing.fill([np.array(u) for u in units], 60)
    assert not rest and all(len({u % 4 for u, _, _ in w}) == 1 for w in windows)


def brute_viterbi(chars, v):
    best, back = [0.0] + [-np.inf] * len(chars), [None] * (len(chars) + 1)
    for end in range(1, len(chars) + 1):
        for start in range(end):
            found = v.ids.get(chars[start:end])
            s = best[start] + (found[1] if found else v.penalty if end - start == 1 else -np.inf)
            if s > best[end]:
                best[end], back[end] = s, (start, found and found[0])
    out, at = [], len(chars)
    while at:
        start, piece = back[at]
        out.append(v.fallback(chars[start]) if piece is None else [piece])
        at = start
    return [i for x in reversed(out) for i in x]


def test_streaming_viterbi_against_brute_force_and_back(spark, vocab):
    v = sentencepiece.vocabulary(vocab("piece_bpe_32k.model"))
    r = random.Random(4)
    texts = ["", " ", "  two  spaces ", "日本語\nx🙂", "a" * 300, "\x00\x01", "".join(r.choice("abthe 🙂é\n▂") for _ in range(400)), "internationalization " * 10]
    for t in texts:
        want = brute_viterbi(v.marked(t), v)
        assert sentencepiece.encode(t, v) == want
        for every in (1, 7, 64):
            assert list(sentencepiece.viterbi(v.marked(t), v, every)) == want
        assert sentencepiece.decode(want, v) == t
    long = "".join(r.choice("abthe") for _ in range(5000)).replace("\n", "")
    assert sentencepiece.encode(long, v) == list(sentencepiece.viterbi(v.marked(long), v, 10**9)) and len(v.split(v.marked(long))) == 1
    got = sentencepiece.encode_texts(make(spark, [(1, None), (2, "x y"), (2, "x y"), (None, "z")]), vocab("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.n_ids) for r in got)[1] == (1, 0) and len(got) == 4
    assert {r.decoded_sha256 for r in got if r.doc_id == 2} == {hashlib.sha256(b"x y").hexdigest()}


def test_segmentation_against_the_library_on_a_unigram_model(vocab, tmp_path):
    """The file's pieces and scores read as a unigram model, texts taken as they are: the library's path has the same score."""
    import sentencepiece as library

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(vocab("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.normalizer_spec.name, model.normalizer_spec.precompiled_charsmap, model.normalizer_spec.remove_extra_whitespaces = "identity", b"", False
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(model.SerializeToString())
    sp, v = library.SentencePieceProcessor(model_file=path), sentencepiece.Vocabulary(path)
    r = random.Random(12)
    words = ["the", "internationalization", "a", "zebra", "naïve", "quick", "ologies", "foo_bar", "3.14", "don't"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(60)] + ["".join(r.choice("abcdefgh") for _ in range(40))]
    score = lambda ids: sum(sp.get_score(i) for i in ids)
    for t in texts:
        mine, theirs = sentencepiece.encode(t, v), sp.nbest_encode_as_ids(t, 2)[0]
        # The library adds in single precision, and some pieces score a billion below the rest.
        assert abs(score(mine) - score(theirs)) <= 1 + 2e-7 * abs(score(mine)) and sp.decode(mine) == t


def test_decoding_finds_the_likeliest_of_all_readings(spark):
    """decode() against every way to read each sign: as a letter it may stand for, as a repeat, or as nothing."""
    docs = make(spark, [(0, "a cab is tall, so is a bat; else ales stall")])
    model = toxicity.log_model(toxicity.letter_counts(docs))
    r = random.Random(2)

    def readings(token):
        """(log chance, word) of every reading, sign by sign."""
        open_ = [(0.0, 0, "")]
        for at, sign in enumerate(token):
            again, grown = at and token[at - 1] == sign, []
            for chance, state, word in open_:
                letters = {sign: toxicity._PLAIN} if sign.isalpha() else {x: toxicity._LOOK for x in toxicity.LOOKALIKES.get(sign, "")}
                if sign in toxicity.MASKS:
                    letters |= dict.fromkeys("abcdefghijklmnopqrstuvwxyz", toxicity._MASK)
                for x, p in letters.items():
                    grown.append((chance + model[state, ord(x) - 96] + p, ord(x) - 96, word + x))
                stays = []
                if again and state and (chr(96 + state) == sign or chr(96 + state) in toxicity.LOOKALIKES.get(sign, "")):
                    stays.append(toxicity._AGAIN)
                if not sign.isalpha():
                    stays.append(toxicity._DIGIT if sign.isdigit() else toxicity._NOISE)
                if stays:
                    grown.append((chance + max(stays), state, word))
            open_ = grown
        return sorted(((c + model[s, 0], w) for c, s, w in open_), reverse=True)

    for _ in range(60):
        token = "".join(r.choice("aabls41.@*$ee") for _ in range(r.randint(1, 5)))
        found = readings(token)
        ties = {w for c, w in found if abs(c - found[0][0]) < 1e-9}
        assert toxicity.decode(token, model) in ties, token


def test_letter_pairs_do_not_depend_on_how_texts_lie(spark):
    rows = [(0, "ab"), (1, "cd "), (2, None), (3, ""), (4, "x")]
    whole = toxicity.letter_counts(make(spark, rows).coalesce(1))
    want = np.zeros((28, 28))
    for word in ("ab", "cd", "x"):
        for a, b in zip("`" + word, word + "`"):
            want[ord(a) - 96, ord(b) - 96] += 1
    want[0, 0] += 1  # the blank after cd, before the end of its text
    assert (whole == want).all() and (toxicity.letter_counts(make(spark, rows).repartition(5)) == want).all()


def test_labels_that_repeat_or_disagree(spark):
    rows = [(i, "fine words here" if i % 2 else "idiot idiot moron") for i in range(80)]
    labels = [(i, int(i % 2 == 0)) for i in range(80)] + [(0, 0), (1, 1), (1, 1)]
    docs, known = make(spark, rows + [(0, "fine words here")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(got) == 81 and all(0 <= x.score <= 1 for x in got)
    assert toxicity.fit(docs, known, max_rows=0).places == {}


def test_a_very_long_text_is_scored_whole(spark):
    rows = [(i, "fine words here " * 3 if i % 2 else "idiot moron " * 3) for i in range(200)]
    docs, known = make(spark, rows + [(999, "calm " * 300_000 + "idiot moron " * 50_000)]), spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    assert got[999] == 1


def test_disguises_are_undone(spark):
    docs = make(spark, [(i, "the stupid idiot and the moron with a loser stated this house") for i in range(30)])
    restorer = toxicity.Restorer(toxicity.letter_counts(docs))
    assert restorer.words("st*pid 1d10t m0r0n L0SER") == {"stupid": 1, "idiot": 1, "moron": 1, "loser": 1}
    assert restorer.words("i d i o t")["idiot"] == 1
    assert restorer.words("s.t.u.p.i.d stuuuupid idiot$$$ plain, words") == {"stupid": 2, "idiot": 1, "plain": 1, "words": 1}
    assert restorer.words(None) == {} and restorer.words("12 -- %%") == {}


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    plain = ["the", "house", "stands", "near", "water", "and", "trees", "other", "stone", "road"]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) + r.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for bad in ("idiot", "moron"):
                w.insert(r.randrange(40), bad if i % 2 else bad.replace("o", "0"))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, "")]
    docs, known = make(spark, rows), spark.createDataFrame(labels + [(1000, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [x for x in got if zlib.crc32(str(x.doc_id).encode()) % 5 == 0 and x.doc_id < 900]
    assert sum(x.predicted == int(x.doc_id % 5 == 0) for x in held) / len(held) > 0.95
    assert {x.predicted for x in got if x.doc_id >= 900} == {0}


def test_packing_asks_with_all_ids_of_a_seed():
    shared = np.arange(100, 120)
    units = [np.concatenate([np.arange(30), shared]), *[np.arange(1000 * i, 1000 * i + 20) for i in range(1, 6)], shared]
    windows, _ = packing.fill(units, 70)
    assert windows[0] == [(0, 0, 50), (6, 0, 20)]


def test_disguises_of_letters_and_spaced_chunks_are_undone(spark):
    docs = make(spark, [(i, "the stupid idiot and such a moron with a loser stated this house") for i in range(30)])
    counts = toxicity.letter_counts(docs)
    r = toxicity.Restorer(counts, ["idiot", "moron", "stupid"])
    assert r.words("idioot mooron stuupid \u0456diot \u00efdiot m\u00f6r0n") == {"idiot": 3, "moron": 2, "stupid": 1}
    assert r.words("such a m o r o n")["moron"] == 1
    assert {"idiot", "moron"} <= set(r.words("i d i o t m o r o n")) and r.words("i\nd  i\to\nt")["idiot"] == 1
    assert r.words("id io t")["idiot"] == 1 and r.words("m 0 r o n")["moron"] == 1
    assert r.words("it is so") == {"it": 1, "is": 1, "so": 1}
    for t in ("letter", "stuuupid", "idioot"):
        assert r.plain(t) == toxicity.decode(t, r.model)


def test_remembered_strings_are_worked_out_again_when_forgotten(vocab, monkeypatch):
    monkeypatch.setattr(sentencepiece.Remembered, "ROOM", 3)
    v = sentencepiece.Vocabulary(vocab("piece_bpe_32k.model"))
    texts = ["one two three four", "four\nfive\tsix  seven", "one " + "x" * 200, " one two", "two▁three", "eight nine ten one two", "a\n b \tc"]
    for t in texts * 2:
        assert sentencepiece.encode(t, v) == brute_viterbi(v.marked(t), v)
        assert len(v.words) <= 3 and len(v.words.before) <= 3


def test_toxicity_takes_columns_of_any_name(spark):
    kind = "doc_id long, text string, `__text` string, `__id` string, `__toxic` int, text2 string, row string, score string, toxic string"
    docs = spark.createDataFrame([(i, t, "a", "b", 1, "c", "d", "e", "f") for i, t in enumerate(["good words", "bad words", None, ""])], kind)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(4)] + [(1, 1, "x")] * 3, "doc_id long, toxic int, `__id` string")
    got = toxicity.score(docs, toxicity.fit(docs, labels), keep=True)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert [(r["__text"], r["__id"], r["__toxic"], r.row, r.toxic) for r in got.collect()] == [("a", "b", 1, "d", "f")] * 4
