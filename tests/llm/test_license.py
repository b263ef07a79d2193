import random
import re

from graphloom.llm import license

KIND = "doc_id long, text string, labels string, blocks int"
CLASH = "doc_id long, text string, labels string, words string, starts string, lines string, held string, row string, `__words` string, `a b` string"
TEXTS = [
    None, "", "mit license", "The MIT-License! and the mit  License", "Licensed under the Apache License, Version 2.0.", "licensed under apache license version 2 0",
    "GENERAL public licenses", "a general public license b general public license", "x\nReleased under the MIT License.\ny", "Licensed under CC BY-NC 4.0.", "mitKicense mit lİcense", "word " * 20000 + "mit license",
    "This work is licensed under the GNU General Public License, version 3.", "license", "general mit license apache license",
]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(license.WORD, low)


def brute(text, threshold=0.8):
    w = words(text)
    places = [(i, label) for phrase, label in license.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    found = {}
    for line in (text or "").split("\n"):
        b = set(words(line))
        for label, t in license.TEMPLATES:
            t = set(words(t))
            if len(b & t) >= threshold * len(t) - 1e-9:
                found[label] = max(found.get(label, 0), len(b & t) / len(t))
    base = {x for _, x in places}
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if places else max(found.values(), default=0.0))


def test_scan_against_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "clash", 1)]
    got = license.scan(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(r.text), r.text


def test_prefixes_follow_the_corpus_and_filters_lose_nothing(spark):
    df = spark.createDataFrame([(i, "licensed under the the", None, None) for i in range(5)] + [(9, "version version", None, None)], KIND)
    plan = {p.label: p for p in license.plan_templates(df)}["apache-2.0-notice"]
    assert set(plan.tokens[-3:]) == {"licensed", "under", "the"} and len(plan.prefix) == len(plan.tokens) - plan.need + 1
    for t in (0.3, 0.6, 1.0):
        rows = [(i, x, None, None) for i, x in enumerate(TEXTS)]
        got = {r.doc_id: r.labels for r in license.scan(spark.createDataFrame(rows, KIND), threshold=t).collect()}
        assert got == {i: brute(x, t)[5] for i, x in enumerate(TEXTS)}


def test_empty_table_and_no_python(spark):
    df = license.scan(spark.createDataFrame([], KIND))
    assert df.count() == 0
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_wrapped_and_commented_grants_are_found(spark):
    by = dict(license.TEMPLATES)
    texts, want = ["the a of this"], [set()]
    for label, mark in (("mit-grant", "# "), ("gpl-grant", " * "), ("bsd-grant", "// "), ("cc-by-nc-4.0-notice", "")):
        w = by[label].split()
        texts.append("first line\n" + "\n".join(mark + " ".join(w[i : i + 5]) for i in range(0, len(w), 5)) + "\nlast line")
        want.append({label})
    rows = license.scan(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], KIND)).collect()
    for r, labels in zip(sorted(rows, key=lambda r: r.doc_id), want):
        assert labels == {x.label for x in r.blocks} and labels <= set(r.labels.split(",") if r.labels else [])
        assert all(x.block == 1 and x.containment == 1 for x in r.blocks) and r.score == float(bool(labels))


def runs(text, threshold=0.8):
    """Blocks over line breaks by trying every run: the best first, then the next that overlaps none, and so on."""
    w, out = words(text), []
    ends, n = [], 0
    lines = (text or "").split("\n")
    for line in lines:
        n += len(words(line))
        ends.append(n)
    by_line = []
    for label, t in license.TEMPLATES:
        length, t = len(words(t)), list(dict.fromkeys(words(t)))
        need = next(k for k in range(len(t) + 1) if k >= threshold * len(t) - 1e-9)
        share = lambda b: len(set(b) & set(t))  # noqa: B023, E731
        by_line += [(i, label, share(words(x)) / len(t), e - len(words(x)), e) for i, (x, e) in enumerate(zip(lines, ends)) if share(words(x)) >= need]
        fit = sorted((-share(w[i : i + length]), i, min(i + length, len(w))) for i, x in enumerate(w) if x in t and share(w[i : i + length]) >= need)
        taken = []
        for worse, a, b in fit:
            if all(y[2] <= a or b <= y[1] for y in taken):
                taken.append((worse, a, b))
        out += [(sum(e <= a for e in ends), label, -worse / len(t), a, b) for worse, a, b in taken]
    better = [x for x in out if not any(y[1] == x[1] and y[2] >= x[2] and y[3] < x[4] and x[3] < y[4] for y in by_line)]
    return sorted(by_line + better)


def wrapped(label, width, mark="", drop=()):
    w = [x for i, x in enumerate(dict(license.TEMPLATES)[label].split()) if i not in drop]
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_every_block_is_found_over_line_breaks(spark, monkeypatch):
    r = random.Random(4)
    labels, texts = [x for x, _ in license.TEMPLATES], list(TEXTS)
    mit, gpl = dict(license.TEMPLATES)["mit-grant"], dict(license.TEMPLATES)["gpl-grant"]
    texts += [
        wrapped("mit-grant", 5) + "\n\n" + wrapped("mit-grant", 7, "# "), mit + "\nx\n" + wrapped("mit-grant", 4), wrapped("mit-grant", 6) + "\n" + wrapped("gpl-grant", 6, " * "), mit + " " + mit, "\n".join([mit] * 3),
        wrapped("bsd-grant", 3, "// ", drop={1, 4}), "word\n" * 700 + wrapped("gpl-grant", 4) + "\nx y" * 600 + "\n" + wrapped("mit-grant", 9), gpl[: len(gpl) // 2] + "\n" + mit,
    ]
    for _ in range(25):
        parts = []
        for _ in range(r.randint(1, 5)):
            label = r.choice(labels)
            n = len(dict(license.TEMPLATES)[label].split())
            parts.append(wrapped(label, r.randint(1, 12), r.choice(["", "# ", "** "]), set(r.sample(range(n), r.randint(0, n // 4)))))
            parts.append(" ".join(r.choice(["a", "the", "of", "license", "software", "zz"]) for _ in range(r.randint(0, 8))))
        texts.append(r.choice(["\n", " ", "\n\n"]).join(parts))
    for chunk in (256, 3):
        monkeypatch.setattr(license, "CHUNK", chunk)
        got = license.scan(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], KIND)).collect()
        for x in got:
            found = [(b.block, b.label, b.containment, b.first, b.end) for b in x.blocks]
            assert sorted(found) == runs(texts[x.doc_id]), texts[x.doc_id]
    assert sum(b.label == "mit-grant" for b in got[len(TEXTS)].blocks) == 2 and sum(b.label == "mit-grant" for b in got[len(TEXTS) + 1].blocks) == 2


def test_columns_of_any_name_stay(spark):
    rows = [(1, "mit license", *"abcdefgh"), (2, None, *"abcdefgh")]
    df = spark.createDataFrame(rows, CLASH)
    got = license.scan(df)
    assert got.columns == [c for c in df.columns if c != "labels"] + ["n_words", "n_base", "first_word", "last_word", "base_labels", "blocks", "labels", "score"]
    assert [(r.words, r.starts, r.lines, r.held, r.row, r["__words"], r["a b"], r.labels) for r in got.orderBy("doc_id").collect()] == [(*"bcdefgh", "mit"), (*"bcdefgh", "")]
