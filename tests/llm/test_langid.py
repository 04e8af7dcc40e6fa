import random
import zlib

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from barloom.llm import langid
from barloom.llm.queries import op2_cross_parsing


def shown(text: str, parser: langid.CrossParser) -> str:
    return "".join(chr(code) for code in langid.classified(text, parser.alphabet))


def brute_phrases(text: str, sample: str) -> int:
    """Phrases of a text in classes: the longest start that the sample holds, again and again."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[end] != chr(langid.OTHER) and text[at] != chr(langid.OTHER) and text[at : end + 1] in sample and text[at:end] in sample:
            end += 1
        count, at = count + 1, end
    return count


SAMPLES = {"aa": ["the cat sat on the mat and that was that", "a rat ran"], "bb": ["der hund und die katze"]}
PARSER = langid.CrossParser(SAMPLES)


@given(st.text(alphabet="abcdehrtuz .ÄéT", max_size=200))
def test_phrases_against_substring_search(text):
    codes = langid.classified(text, PARSER.alphabet)
    if not len(codes):
        return
    seen = shown(text, PARSER)
    found = PARSER.phrases(codes.reshape(1, -1))
    for at, language in enumerate(PARSER.languages):
        sample = chr(langid.OTHER).join([*(shown(text, PARSER) for text in SAMPLES[language]), ""])
        assert found[at, 0] == brute_phrases(seen, sample)


SCRIPTS = {"el": 0x3B1, "ru": 0x430, "ar": 0x627, "hi": 0x915, "ka": 0x10D0, "hy": 0x561, "ko": 0xAC00, "zh": 0x4E00, "ja": 0x3042}


def test_languages_of_many_scripts():
    """No letter of a sample is lost, however many there are; a language has no advantage by its name or length."""
    pick = random.Random(7)
    letters = {lang: [chr(start + k) for k in range(900 if lang in ("ko", "zh") else 20)] for lang, start in SCRIPTS.items()}
    letters |= {"en": [*"abcdefghijklmnopqrstuvwxyz"], "zh2": letters["zh"]}
    words = {lang: ["".join(pick.choices(chars, k=4)) for _ in range(400)] for lang, chars in letters.items()}
    text = lambda lang, n: " ".join(pick.choices(words[lang], k=n))
    parser = langid.CrossParser({lang: [text(lang, 60 if lang == "hy" else 1500)] for lang in letters})
    asked = [lang for lang in letters for _ in range(5)]
    made = parser.predict(pd.Series([text(lang, 30) for lang in asked]))
    assert list(made["lang_pred"]) == asked


def brute_sparse(text: str, sample: str, known: set[str]) -> int:
    """Phrases by substring search, with letters as they are."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at] in known and text[at : end + 1] in sample:
            end += 1
        count, at = count + 1, end
    return count


def test_thousands_of_letters_against_substring_search():
    """Seven languages at once, two of them of 3,000 letters; unseen texts are told apart, and phrases are those of substring search."""
    pick = random.Random(11)
    han, kana = [chr(0x4E00 + k) for k in range(3000)], [chr(0x3041 + k) for k in range(80)]
    alphabets = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": [chr(0x430 + k) for k in range(32)], "el": [chr(0x3B1 + k) for k in range(25)], "ar": [chr(0x627 + k) for k in range(20)], "hi": [chr(0x915 + k) for k in range(36)]}
    words = {lang: ["".join(pick.choices([*chars], k=5)) for _ in range(300)] for lang, chars in alphabets.items()}
    weights = [1 / (k + 3) for k in range(3000)]
    mixed = lambda chars, n: "".join(pick.choices(chars, k=n))
    made = {lang: (lambda own: lambda n: " ".join(pick.choices(own, k=n)))(own) for lang, own in words.items()}
    made["zh"] = lambda n: "".join(pick.choices(han, weights, k=n * 3))
    made["ja"] = lambda n: "".join(mixed(kana, 3) + pick.choices(han[::-1], weights, k=1)[0] for _ in range(n))
    samples = {lang: [text(40) for _ in range(100)] for lang, text in made.items()}
    parser = langid.CrossParser(samples)
    asked = [lang for lang in made for _ in range(50)]
    texts = [made[lang](30) for lang in asked]
    found = list(parser.predict(pd.Series(texts))["lang_pred"])
    assert sum(a == b for a, b in zip(found, asked, strict=True)) >= 0.95 * len(asked)
    assert all(sum(a == b for a, b in zip(found, asked, strict=True) if b == lang) >= 45 for lang in made)
    assert {*"".join(samples["zh"] + samples["ja"])} <= {*parser.alphabet} and len(parser.alphabet) > 2000
    for text in texts[::37]:
        counted = parser.phrases(langid.classified(text, parser.alphabet).reshape(1, -1))[:, 0]
        for language, n in zip(parser.languages, counted, strict=True):
            sample = "\0".join(samples[language])
            assert n == brute_sparse(text, sample, {*sample})


def test_sample_is_whole_and_bounded(spark):
    """Long documents give pieces from all over, others all they have; rows that share an id count once; more rows don't gather more."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"begin {'w' * (i % 400)} end{i}", "aa") for i in ids] + [(ids[0], "zz", "aa")] * 100
    rows += [(i, "".join(f"<{k}>" for k in range(60_000)), "bb") for i in ids[:12]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    sample = langid.labelled_sample(docs)
    chars = {lang: sum(map(len, texts)) for lang, texts in sample.items()}
    assert langid.SAMPLE_CHARS <= chars["aa"] < langid.SAMPLE_CHARS + 500 and langid.SAMPLE_CHARS <= chars["bb"] < langid.SAMPLE_CHARS + langid.DOC_CHARS
    assert all(text.startswith("begin") and "end" in text for text in sample["aa"]) and len({*sample["aa"]}) == len(sample["aa"])
    assert all("<59999>" in text and "<30" in text and len(text) <= langid.DOC_CHARS + 8 for text in sample["bb"])
    assert langid.labelled_sample(docs.repartition(3)) == sample


def test_sparse_and_dense_count_alike():
    wide = langid.CrossParser(SAMPLES | {"cc": ["".join(chr(0x4E00 + k) for k in range(300))]})
    texts = pd.Series(["the cat and der hund", "ein Rat, that ran", "zzz the", "und " * 200])
    for text in texts:
        narrow, other = (parser.phrases(langid.classified(text, parser.alphabet).reshape(1, -1)) for parser in (PARSER, wide))
        assert narrow[:, 0].tolist() == other[:2, 0].tolist()


def test_suffix_automaton_holds_the_substrings():
    automaton = langid.suffix_automaton([ord(c) for c in "abcbcabab"])

    def holds(text: str) -> bool:
        state = 0
        for char in text:
            state = automaton[state].get(ord(char), -1)
            if state < 0:
                return False
        return True

    letters = ["", *"abc"]
    assert all(holds(a + b + c) == (a + b + c in "abcbcabab") for a in letters for b in letters for c in letters)


def test_segments_add_up():
    text = "the cat " * 4000 + "hund"
    one = PARSER.predict(pd.Series([text, "", None, "...", "der hund"]))
    assert list(one["lang_pred"]) == ["aa", "und", "und", "und", "bb"]
    assert list(one["score"][1:4]) == [0.0, 0.0, 0.0] and 0 < one["score"][4] <= 1


@pytest.mark.parametrize("fold", [True, False])
def test_query_is_right_on_most(spark, sf_dir, fold):
    truth = {row["doc_id"]: row["lang"] for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [row for row in op2_cross_parsing(spark, sf_dir).collect() if row["held_out"] == fold]
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2) for row in rows)
    assert sum(row["lang_pred"] == truth[row["doc_id"]] for row in rows) >= 0.97 * len(rows)


def test_only_learning_rows_teach(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    docs = spark.createDataFrame([(held, "abc", "xx"), (None, "abc", "yy"), (held + 1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.labelled_sample(docs) == {}
    assert {row["lang_pred"] for row in langid.identify(docs).collect()} == {"und"}


def test_odd_documents(odd_documents, no_documents):
    rows = langid.identify(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {row["lang_pred"] for row in rows if row["doc_id"] in (2, 3, 6, 7)} == {"und"}
    assert len({row["lang_pred"] for row in rows if row["doc_id"] in (8, 9)}) == 1
    assert langid.identify(no_documents).collect() == []
