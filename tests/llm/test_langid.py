import math

import numpy as np
import public_tokenizers
import pytest

from lodestar.llm import langid

PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_scores_sum_over_all_segmentations():
    pieces = ["a", "ab", "b", "bc", "abc"]
    held = langid.Pieces(pieces)
    table = np.array([[0.2], [0.1], [0.3], [0.05], [0.02], [1e-6], [0.0]])
    p = dict(zip(pieces, table[:, 0], strict=False))

    def brute(word):
        if not word:
            return 1.0
        return sum(p.get(word[:k], 1e-6 if k == 1 else 0) * brute(word[k:]) for k in range(1, min(langid.LONGEST, len(word)) + 1))

    for word in ("abc", "c", "abab", "zabc", "ab" * 12):
        assert langid.log_scores(held, table, [word])[0, 0] == pytest.approx(math.log(brute(word)))
    assert np.isfinite(langid.log_scores(held, table, ["ab" * 5000])).all()


def test_held_out_languages(sample):
    found = langid.identify(sample, PIECES).join(sample.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(found) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.95


def test_defined_cases(docs, nothing):
    found = {r["doc_id"]: r for r in langid.identify(docs, PIECES).collect()}
    assert {found[i]["lang_pred"] for i in (2, 3, 4)} == {"und"} and found[2]["score"] == 0
    assert found[1]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.identify(nothing, PIECES).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false").unionByName(docs.withColumn("lang", docs.source)), PIECES).collect()} == {"und"}


def test_slices_change_nothing(monkeypatch):
    text = "der hund und die katze " * 40 + "x" * 300
    whole = [w for ws in langid._split(text) for w in ws]
    monkeypatch.setattr(langid, "SLICE", 50)
    assert [w for ws in langid._split(text) for w in ws] == whole


def cuts(word, longest):
    """All ways to cut a word into runs of at most `longest` letters."""
    if not word:
        yield []
    for k in range(1, min(longest, len(word)) + 1):
        for rest in cuts(word[k:], longest):
            yield [word[:k], *rest]


def brute_learn(pieces, counts):
    """Expectation maximisation that lists every segmentation."""
    letter = len(pieces)
    index = {p: i for i, p in enumerate(pieces)}
    at = lambda piece: index.get(piece, letter if len(piece) == 1 else None)
    p = [1 / (letter + 1)] * (letter + 1)
    for _ in range(langid.ROUNDS):
        seen = [0.0] * (letter + 1)
        for word, n in counts.items():
            ways = [[at(x) for x in c] for c in cuts(word, 9)]
            ways = [w for w in ways if None not in w]
            weights = [math.prod(p[i] for i in w) for w in ways]
            for w, x in zip(ways, weights, strict=True):
                for i in w:
                    seen[i] += n * x / sum(weights)
        total = sum(seen) + langid.SMOOTH * (letter + 1)
        p = [(x + langid.SMOOTH) / total for x in seen]
    return p


def test_the_whole_query_equals_brute_force(spark, tmp_path):
    import base64
    import re
    import zlib

    pieces = ["a", "ab", "abc", "b", "ca", "der", "e", "r"]
    vocab = tmp_path / "ranks"
    vocab.write_bytes(b"".join(base64.b64encode(p.encode()) + b" %d\n" % i for i, p in enumerate(pieces)))
    texts = {1: ("ab abc Cab zabc", "x"), 2: ("der erde der r", "y"), 3: ("abc der", None), 4: ("² ½ Ⅷ ①", None), 5: ("ABCA²der", "x"), 6: ("re der, b", "y"), 7: ("", "x"), 8: ("q", "y"), 9: ("bcab er", "x")}
    df = spark.createDataFrame([(i, t, lang, "s") for i, (t, lang) in texts.items()], "doc_id long, text string, lang string, word string")
    found = {r["doc_id"]: r for r in langid.identify(df, str(vocab)).collect()}
    taught = {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    counts = {"x": {}, "y": {}}
    words = lambda t: re.findall("[a-z]+", t.lower())
    for i in taught:
        for w in words(texts[i][0]):
            if lang := texts[i][1]:
                counts[lang][w] = counts[lang].get(w, 0) + 1
    learned = {lang: brute_learn(pieces, c) for lang, c in counts.items()}
    index = {p: i for i, p in enumerate(pieces)}
    for i, (text, _) in texts.items():
        assert found[i]["held_out"] == (i not in taught)
        if not words(text):
            assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
            continue
        logs = {}
        for lang, p in learned.items():
            at = lambda x: p[index[x]] if x in index else p[-1] if len(x) == 1 else 0  # noqa: B023, E731
            logs[lang] = sum(math.log(sum(math.prod(map(at, c)) for c in cuts(w, 9))) for w in words(text))
        best = max(logs, key=lambda k: (logs[k], k == "x"))
        assert found[i]["lang_pred"] == best
        assert found[i]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))


def test_numerals_are_no_letters(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de"), ("²", None), ("½ ①", None), ("Ⅷ 12 _ !", None), ("x" * 10_000, None)] * 3)], "doc_id long, text string, lang string")
    found = langid.identify(df, PIECES).collect()
    assert {r["lang_pred"] for r in found if r["doc_id"] % 6 in (2, 3, 4)} == {"und"}
    assert all(r["lang_pred"] != "und" and 0 <= r["score"] <= 1 for r in found if r["doc_id"] % 6 not in (2, 3, 4))


def test_scripts_without_blanks_teach(spark):
    """Runs of hundreds of letters, as they stand in Chinese and Japanese texts."""
    import random

    rng = random.Random(1)
    zh, ja = "的一是不了人我在有他这中大来上国", "のにはをたがでてとしれさいるなも"
    rows = [(i, "".join(rng.choice(ja if i % 2 else zh) for _ in range(300)), "ja" if i % 2 else "zh") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ("ja" if r["doc_id"] % 2 else "zh") for r in langid.identify(df, PIECES).collect())


def test_learning_in_parts_changes_nothing(monkeypatch):
    words = ["ab", "abc", "abab", "cab", "b" * 32, "abcabc"]
    held, counts = langid.Pieces(["a", "ab", "b", "bc", "abc"]), np.arange(1.0, 7)
    whole = langid.learn_pieces(held, words, counts)
    monkeypatch.setattr(langid, "HELD", 64)
    assert np.allclose(langid.learn_pieces(held, words, counts), whole)


def test_scripts_that_the_vocabulary_has_no_letters_of(spark):
    """Languages whose letters are no pieces, only their bytes are."""
    import random

    rng = random.Random(5)
    scripts = {"ka": (0x10D0, 33), "am": (0x1200, 60), "te": (0x0C05, 40), "lo": (0x0E81, 30), "x1": (0x10D0, 33)}
    weights = {lang: [rng.random() ** 3 + 0.01 for _ in range(n)] for lang, (_, n) in scripts.items()}

    def text(lang):
        first, n = scripts[lang]
        return " ".join("".join(c for c in map(chr, rng.choices(range(first, first + n), weights[lang], k=rng.randint(2, 9)))) for _ in range(60))

    rows = [(i, text(lang := list(scripts)[i % 5]), lang) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(df, PIECES).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 40 and all(r["lang_pred"] == r["lang"] and r["score"] > 0.9 for r in found)


def test_all_bytes_of_letters_are_pieces():
    pieces = langid.read_pieces(PIECES)
    assert {chr(c) for c in [*range(97, 123), *range(0x80, 0x100)]} <= set(pieces)
    assert langid.units("né") == "nÃ©" and langid.units("abc") == "abc"


def test_weighing_changes_no_share(monkeypatch):
    words = ["ab", "abc", "abab", "cab", "b" * 32, "abcabc"]
    held, counts = langid.Pieces(["a", "ab", "b", "bc", "abc"]), np.arange(1.0, 7)
    plain = langid.learn_pieces(held, words, counts)
    monkeypatch.setattr(langid, "PLAIN", 0)
    assert np.allclose(langid.learn_pieces(held, words, counts), plain)
