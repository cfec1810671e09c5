import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsight.llm.language import BLOCK, WIDTH, Model, _folded, encode, identify, is_held_out, labelled_samples, suffix_automaton

SAMPLES = {"aa": "banana bandana cabana ananas " * 8, "bb": "quick brown foxes jump over lazy dogs " * 8}


def plain_phrases(text, sample):
    """Greedy longest phrases by plain search; a character that the sample lacks is a phrase of its own."""
    count, phrase = 1, ""
    for char in text:
        if phrase + char in sample:
            phrase += char
        else:
            count += 1
            phrase = char if char in sample else ""
    return count


def as_text(symbols):
    return "".join(chr(65 + s) for s in symbols)


def test_phrases_equal_plain_search():
    rng = random.Random(1)
    model = Model(SAMPLES)
    samples = [as_text(encode(_folded(SAMPLES[n]), model.own)) for n in model.languages]
    blocks = [np.array([rng.randrange(model.width) for _ in range(rng.randint(1, 40))]) for _ in range(30)]
    blocks += [encode(_folded(t), model.own) for t in ("bandana", "lazy fox", "zzz", "\u0436\u6f22")]
    found = model.phrases(blocks)
    for i, block in enumerate(blocks):
        assert found[:, i].tolist() == [plain_phrases(as_text(block), s) for s in samples]


def test_automaton_knows_exactly_the_substrings():
    text = [0, 1, 0, 0, 1, 2, 1, 0]
    table = suffix_automaton(text, 3)

    def known(part):
        state = 0
        for symbol in part:
            state = table[state, symbol]
            if state < 0:
                return False
        return True

    rng = random.Random(2)
    for _ in range(300):
        part = [rng.randrange(3) for _ in range(rng.randint(1, 5))]
        assert known(part) == any(text[i : i + len(part)] == part for i in range(8))


def test_predictions(docs_of):
    rows = [(1, "a banana in a cabana"), (2, "The QUICK foxes"), (3, None), (4, ""), (5, "12 !? \n"), (6, "banana " * 50_000)]
    rows += [(None, "lazy dogs"), (1, "a banana in a cabana"), (8, "漢字")]
    found = identify(docs_of(rows), SAMPLES).collect()
    by_text = {r.text: r for r in found}
    assert len(found) == len(rows) and set(found[0].asDict()) >= {"doc_id", "lang_pred", "score", "label"}
    want = {"a banana in a cabana": "aa", "The QUICK foxes": "bb", None: "und", "": "und", "12 !? \n": "und", "lazy dogs": "bb"}
    assert {t: by_text[t].lang_pred for t in want} == want
    assert all(0.0 <= r.score <= 1.0 for r in found) and by_text[None].score == 0.0
    assert len(rows[5][1]) > BLOCK and by_text[rows[5][1]].lang_pred == "aa"
    assert by_text["漢字"].lang_pred in SAMPLES
    assert identify(docs_of([]), SAMPLES).collect() == []
    with pytest.raises(ValueError):
        Model({})


def test_held_out_rows_teach_nothing(spark, docs_of):
    rows = [(d, f"word{d}", "xx") for d in range(40)] + [(None, "null", "yy"), (41, None, "xx"), (42, "x", None)]
    sample = labelled_samples(docs_of(rows))
    taught = {f"word{d}" for d in range(40) if zlib.crc32(str(d).encode()) % 4 != 2}
    assert set(sample) == {"xx"} and set(sample["xx"].split("\n")) <= taught
    held = spark.range(40).where(is_held_out(F.col("id"))).collect()
    assert {r.id for r in held} == {d for d in range(40) if zlib.crc32(str(d).encode()) % 4 == 2}
    assert labelled_samples(docs_of([])) == {}
    assert {(r.lang_pred, r.score) for r in identify(docs_of(rows), {}).collect()} == {("und", 0.0)}


#: A few plain sentences per language, in scripts that share no letters or nearly all of them.
SCRIPTS = {
    "ru": "\u0432 \u043d\u0430\u0447\u0430\u043b\u0435 \u0431\u044b\u043b\u043e \u0441\u043b\u043e\u0432\u043e \u0438 \u0441\u043b\u043e\u0432\u043e \u0431\u044b\u043b\u043e \u0443 \u0431\u043e\u0433\u0430 \u043e\u043d\u043e \u0431\u044b\u043b\u043e \u0432 \u043d\u0430\u0447\u0430\u043b\u0435",
    "uk": "\u043d\u0430 \u043f\u043e\u0447\u0430\u0442\u043a\u0443 \u0431\u0443\u043b\u043e \u0441\u043b\u043e\u0432\u043e \u0456 \u0441\u043b\u043e\u0432\u043e \u0431\u0443\u043b\u043e \u0432 \u0431\u043e\u0433\u0430 \u0432\u043e\u043d\u043e \u0431\u0443\u043b\u043e \u0441\u043f\u043e\u043a\u043e\u043d\u0432\u0456\u043a\u0443",
    "el": "\u03b5\u03bd \u03b1\u03c1\u03c7\u03b7 \u03b7\u03bd \u03bf \u03bb\u03bf\u03b3\u03bf\u03c2 \u03ba\u03b1\u03b9 \u03bf \u03bb\u03bf\u03b3\u03bf\u03c2 \u03b7\u03bd \u03c0\u03c1\u03bf\u03c2 \u03c4\u03bf\u03bd \u03b8\u03b5\u03bf\u03bd",
    "ar": "\u0641\u064a \u0627\u0644\u0628\u062f\u0621 \u0643\u0627\u0646 \u0627\u0644\u0643\u0644\u0645\u0629 \u0648\u0627\u0644\u0643\u0644\u0645\u0629 \u0643\u0627\u0646 \u0639\u0646\u062f \u0627\u0644\u0644\u0647",
    "zh": "\u592a\u521d\u6709\u9053\u9053\u4e0e\u795e\u540c\u5728\u9053\u5c31\u662f\u795e\u8fd9\u9053\u592a\u521d\u4e0e\u795e\u540c\u5728",
    "ja": "\u521d\u3081\u306b\u8a00\u304c\u3042\u3063\u305f\u8a00\u306f\u795e\u3068\u5171\u306b\u3042\u3063\u305f\u8a00\u306f\u795e\u3067\u3042\u3063\u305f",
    "en": "in the beginning was the word and the word was with god and the word was god",
}


def test_scripts_are_told_apart():
    model = Model({**{name: text * 3 for name, text in SCRIPTS.items()}, "zz": "ok", "qq": "123", "yy": "a"})
    assert "qq" not in model.languages
    for name, text in SCRIPTS.items():
        half = text[: len(text) // 2]
        assert model.predict([half, text[5:]])[0][0] == name and model.predict([text[5:]])[0][0] == name
    # Letters that no sample holds keep their identity, and short samples win nothing.
    assert model.predict(["the word was in the beginning with whom"])[0][0] == "en"
    assert model.predict(["something else entirely, quickly jumping over lazy dogs"])[0][0] == "en"


def test_symbols_of_letters_differ():
    model = Model({"en": SCRIPTS["en"]})
    letters = np.array([0, ord("a"), ord("q"), 0x3B1, 0x431, 0x6F22, 0x20000], dtype=np.uint32)
    codes = [tuple(encode(letters[i : i + 1], model.own)) for i in range(len(letters))]
    assert len(set(codes)) == len(codes) and [len(c) for c in codes] == [1, 1, 3, 3, 4, 4, 5]
    assert max(max(c) for c in codes) < WIDTH
    assert encode(letters, model.own).tolist() == [s for c in codes for s in c]


def test_copies_do_not_fill_a_sample(docs_of):
    rows = [(d, "the same old text again", "en") for d in range(1000)]
    rows += [(d, f"another text number {'abcdefghij'[d % 10] * (d % 7 + 1)}", "en") for d in range(1000, 1200)]
    rows += [(d, "1234 5678", "de") for d in range(1200, 1240)] + [(d, f"ein text {'xyz'[d % 3]}", "de") for d in range(1240, 1260)]
    sample = labelled_samples(docs_of(rows), total_chars=4000, first_rows=2)
    parts = sample["en"].split("\n")
    assert len(parts) == len(set(parts)) > 30 and "1234" not in sample["de"] and sample["de"].count("ein text") == 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs, labelled_samples(docs)).where(is_held_out(F.col("doc_id"))).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) >= 0.97
