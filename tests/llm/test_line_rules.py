"""Cross-document line frequency against a plain version."""

import random
import re

import pytest

from parcelframe.llm import line_rules as L

from .conftest import DOCS, clash, docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    held = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held)]


def fold(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else "0" if c in "0123456789" else c for c in line)
    return " ".join(WORD.findall(low))


def plain_verdicts(rows, max_docs, least_left):
    """rows: (doc_id, text, host); (counts, removed words, base_failed, kept) of each."""
    held = {}
    for i, text, host in rows:
        for line in {fold(x) for x in (text or "").split("\n")} - {""}:
            held.setdefault((host, line), set()).add(i)
    often = {k for k, ids in held.items() if len(ids) > max_docs}
    out = []
    for _, text, host in rows:
        c = plain_counts(text or "")
        gone = sum(len(WORD.findall(x)) for x in (text or "").split("\n") if (host, fold(x)) in often)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((c, gone, failed, not failed and 100 * (c[0] - gone) >= least_left * c[0]))
    return out, often


def sample(words, n=120, seed=1):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(12)]
    texts = []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(rng.randint(0, 8))]
        lines += [s.upper() if rng.random() < 0.3 else s + "  " for s in shared if rng.random() < 0.25]
        lines += rng.choices(lines, k=rng.randint(0, 3)) if lines else []
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    return texts + [None, "", " \n\t\n ", "a b c a b c", "página 12 é x #1\npágina 13 é x #2", "x" * 10, "$5 <b>|&%*# " * 20]


@pytest.mark.parametrize("max_docs,least_left", [(3, 30), (10, 80), (10 ** 6, 30)])
def test_verdicts_as_by_brute_force(spark, words, max_docs, least_left):
    texts = sample(words)
    df = clash(docs_of(spark, texts)).repartition(5)
    hosts = [["s0", "s1", None][k % 3] for k in range(len(texts))]
    want, _ = plain_verdicts(list(zip(range(len(texts)), texts, hosts)), max_docs, least_left)
    got = {r.doc_id: ([r[c] for c in L.COUNTS], r.n_removed_words, r.base_failed, r.kept) for r in L.line_verdicts(df, max_docs=max_docs, least_left=least_left).collect()}
    assert got == dict(enumerate(want))
    kept = [w[3] for w in want]
    assert any(kept) and not all(kept)


def test_clean_texts(spark, words):
    texts = sample(words, seed=3)
    hosts = [["s0", "s1", None][k % 3] for k in range(len(texts))]
    want, often = plain_verdicts(list(zip(range(len(texts)), texts, hosts)), 3, 30)
    got = {r.doc_id: r for r in L.clean_lines(docs_of(spark, texts), max_docs=3).collect()}
    assert set(got) == {i for i, w in enumerate(want) if w[3]}
    for i, r in got.items():
        assert r.text == "\n".join(x for x in texts[i].split("\n") if (hosts[i], fold(x)) not in often)
        assert r.n_chars == len(texts[i]) and r.source == hosts[i] and r.n_removed_words == want[i][1]
    assert any(r.text != texts[i] for i, r in got.items())


def test_limits_repeated_rows_and_null_ids(spark, words):
    line, body = " ".join(words[:20]), " ".join(words[20:120])
    text = line + "\n" + body

    def removed(ids, hosts=("s",)):
        rows = [(i, f"{line}\n{' '.join(words[20 + k:130 + k])}", "en", hosts[k % len(hosts)], 0) for k, i in enumerate(ids)]
        return [r.n_removed_words for r in L.line_verdicts(spark.createDataFrame(rows, DOCS), max_docs=4).collect()]

    assert removed(range(4)) == [0] * 4  # at the limit
    assert removed(range(5)) == [20] * 5
    assert removed([1, 2, 3, 4, 4, 4]) == [0] * 6  # one document for all its rows
    assert removed([1, 2, 3, 4, None, None]) == [20] * 6  # null ids are one more document
    assert removed(range(8), hosts=("s", "t")) == [0] * 8  # hosts count apart
    assert text.count("\n") == 1


def test_hot_line_long_text_and_empty_table(spark, words):
    hot = " ".join(words[:15])
    long = "\n".join(" ".join(words[k % 300:k % 300 + 40]) + f" {'z' * (k % 7)}{chr(97 + k % 23)}{chr(97 + k // 23 % 23)}{chr(97 + k // 529)}" for k in range(7000))
    assert len(long) > 1 << 20
    texts = [f"{hot}\n{' '.join(words[k % 200:k % 200 + 100])} {k}" for k in range(900)] + [long]
    old, L.HEAVY = L.HEAVY, 8  # the hot line passes the broadcast, others the shuffle
    try:
        got = {r.doc_id: r for r in L.line_verdicts(docs_of(spark, texts, sources=["s"]), max_docs=20).collect()}
    finally:
        L.HEAVY = old
    want, _ = plain_verdicts([(i, t, "s") for i, t in enumerate(texts[:-1])], 20, 30)
    assert [got[i].n_removed_words for i in range(900)] == [w[1] for w in want]
    assert got[900].n_words == len(WORD.findall(long)) and got[900].n_removed_words == 0
    assert got[900].n_repeat_words == L.repeated_words(long.encode().split())
    empty = spark.createDataFrame([], DOCS)
    assert L.line_verdicts(empty).count() == 0 and L.clean_lines(empty).columns[:2] == ["doc_id", "text"]


def test_repeated_words_of_large_vocabularies():
    words = [b"%d" % (k % 50_000) for k in range(100_003)]
    assert L.repeated_words(words) == 100_003
    assert L.repeated_words([b"a", b"b", b"c", b"a", b"b", b"c", b"d"]) == 6
    assert L.repeated_words([b"a"] * 3) == 0 and L.repeated_words([b"a"] * 4) == 4
