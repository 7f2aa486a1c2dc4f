import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed_texts as T, flags, prompts, text as tx, vectors as vx


@pytest.mark.parametrize("value, expected", [
    (None, False), ("", False), ("\t", False), (" ", False), ("\x1c", False), (" a", True),
])
def test_non_blank(one, value, expected):
    assert one(tx.is_non_blank, a=value) is expected


def test_white_space_set_matches_python(spark):
    chars = [(i, chr(i)) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame(chars, "i INT, c STRING")
    blank = {r["i"] for r in df.filter(~tx.is_non_blank(F.col("c"))).collect()}
    stripped = {r["i"] for r in df.filter(tx.strip(F.col("c")) == "").collect()}
    expected = {i for i, c in chars if c.isspace()}
    assert blank == expected
    assert stripped == expected


def test_lengths_are_code_points(one):
    assert one(F.length, a="\U0001F926\U0001F3FD‍♂️") == 5


@pytest.mark.parametrize("n, keep", [(29, False), (30, True)])
def test_minimum_length(one, n, keep):
    assert one(lambda c: tx.char_length_between(c, 30), a="x" * n) is keep


@pytest.mark.parametrize("n, keep", [(79, False), (80, True), (1200, True), (1201, False)])
def test_length_range(one, n, keep):
    assert one(lambda c: tx.char_length_between(c, 80, 1200), a="x" * n) is keep


def test_word_tokens(one):
    text = "Don't stop, a1'b naïve"
    assert one(tx.word_tokens, a=text) == ["Don't", "stop", "a1'b", "na", "ve"]
    assert one(lambda c: tx.word_tokens(c, lower=True), a="The the") == ["the", "the"]


def test_ws_tokens_split_like_python(one):
    text = " a b\tc\x1cd e  "
    assert one(tx.ws_tokens, a=text) == text.split()
    assert one(tx.ws_word_count, a=text) == 5
    assert one(tx.ws_word_count, a="") == 0


@pytest.mark.parametrize("text, n, expected", [
    ("a", 2, []), ("a b", 2, ["a b"]), ("a b", 3, []), ("a b c d", 3, ["a b c", "b c d"]),
])
def test_ngrams(one, text, n, expected):
    assert one(lambda c: tx.ngrams(tx.word_tokens(c), n), a=text) == expected


@pytest.mark.parametrize("text, d1, d2, repeat", [
    ("!!! ???", 0.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0), ("a b", 1.0, 1.0, 0.0), ("The the", 1.0, 1.0, 0.0),
    ("a b c x a b c y a b c", 5 / 11, 7 / 10, 2 / 9),
])
def test_ratios(one, text, d1, d2, repeat):
    assert one(lambda c: tx.distinct_n(tx.word_tokens(c), 1), a=text) == pytest.approx(d1)
    assert one(lambda c: tx.repeat_rate(tx.word_tokens(c), 3), a=text) == pytest.approx(repeat)
    grams = text.split()
    pairs = list(zip(grams, grams[1:]))
    if text[0].isalpha():
        expected = len(set(pairs)) / len(pairs) if pairs else 0.0
        assert one(lambda c: tx.distinct_n(tx.word_tokens(c), 2), a=text) == pytest.approx(expected)


def test_case_decides_distinct_one(one):
    assert one(lambda c: tx.distinct_n(tx.word_tokens(c, lower=True), 1), a="The the") == 0.5


def test_cleaning(one):
    assert one(tx.clean_text, a=' say  "hi"\n') == "say 'hi'"
    assert one(tx.clean_text, a="a\tb   c d") == "a b c d"
    assert one(tx.strip_tags, a="a <b\nc> <d>e") == "a <b\nc> e"
    assert one(tx.strip_tags, a="a <b\rc>d") == "a d"
    assert one(tx.clean_generated, a="  REVIEW : good") == "good"
    assert one(tx.clean_generated, a="a review: good") == "a review: good"
    assert one(tx.after_review_colon, a=" Review: a: b ") == "a: b"
    assert one(tx.after_review_colon, a="Review : a") == "Review : a"
    assert one(tx.strip_prompt, a="Say it: yes ", b="Say it:") == "yes"
    assert one(tx.strip_prompt, a=" no ", b="Say it:") == "no"
    assert one(lambda c: tx.snippet(c, 5), a='ab"cdefg') == "ab'cd..."
    assert one(tx.training_text, a="p \n", b="\tc\n") == "p\nc"
    assert one(tx.percent_value, a="68.0%") == pytest.approx(0.68)
    assert one(tx.percent_value, a="10%") == pytest.approx(0.1)


def test_whole_word(one):
    assert one(lambda c: tx.has_word(c, "but"), a="good BUT short")
    assert not one(lambda c: tx.has_word(c, "but"), a="butter")
    assert not one(lambda c: tx.has_word(c, "but"), a="buté")


def test_targets(spark):
    df = spark.createDataFrame([(5,), (6,), (7,), (9,)], "r INT")
    for rule, expected in {"above_5": [0, 1, 1, 1], "at_least_7": [0, 0, 1, 1], "is_9": [0, 0, 0, 1]}.items():
        assert [r[0] for r in df.select(flags.target(F.col("r"), rule)).collect()] == expected


def test_null_vote_is_an_error(spark):
    df = spark.createDataFrame([(True,), (None,)], "v BOOLEAN")
    with pytest.raises(Exception, match="vote is NULL"):
        df.select(flags.to_rating(F.col("v"))).collect()


def test_flags(spark):
    df = spark.createDataFrame([(99,), (100,), (140,), (141,)], "w INT")
    assert [r[0] for r in df.select(flags.range_flag(F.col("w"), 100, 140)).collect()] == [0, 1, 1, 0]
    sims = spark.createDataFrame([(0.8999,), (0.9,)], "s DOUBLE")
    assert [r[0] for r in sims.select(flags.overlap_flag(F.col("s"))).collect()] == [0, 1]
    zero = spark.createDataFrame([(0.0,)], "s DOUBLE").select(
        flags.score_to_label(F.col("s")).alias("l"), flags.score_to_probability(F.col("s")).alias("p")
    ).first()
    assert (zero["l"], zero["p"]) == (1, 0.5)


def test_recode(one):
    assert one(lambda c: flags.recode(c, {"Team Fortress 2": "TF2", "Counter-Strike 2": "CS2"}), a="Team Fortress 2") == "TF2"
    assert one(lambda c: flags.recode(c, {"Team Fortress 2": "TF2", "Counter-Strike 2": "CS2"}), a="Valheim") == "Valheim"


def test_prompts(spark):
    row = spark.createDataFrame([("Dota 2", 7), ("Dota 2", 6)], "t STRING, r INT").select(
        prompts.naive_prompt(F.col("t"), F.col("r")).alias("n"),
        prompts.engineered_prompt(F.col("t"), F.col("r"), F.lit("About.")).alias("e"),
        prompts.training_prompt(F.col("t"), F.col("r")).alias("p"),
    ).collect()
    assert row[0]["n"] == 'Write a Steam user review for the game "Dota 2" with rating 7/10.'
    assert "2 things you genuinely liked" in row[0]["e"] and "2 things you genuinely disliked" in row[1]["e"]
    assert row[0]["e"].splitlines()[7] == "About."
    assert row[0]["p"].startswith("You are a regular Steam user.\n\nWrite a positive ")
    assert "Write a negative " in row[1]["p"] and row[1]["p"].endswith("\n\nReview:")


def test_description_order(spark):
    df = spark.createDataFrame(
        [(570, "anything"), (1, "  TF2 and CS2 "), (1, "Other"), (None, None)], "a INT, t STRING"
    )
    found = [r[0] for r in df.select(prompts.game_description(F.col("a"), F.col("t"))).collect()]
    assert found == [
        T.DESCRIPTION_BY_APP[570], T.DESCRIPTION_BY_APP[730], T.DEFAULT_DESCRIPTION, T.DEFAULT_DESCRIPTION,
    ]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    rows = df.select(vx.l2_normalize(F.col("a")).alias("n"), vx.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert rows[0]["n"] == pytest.approx([0.6, 0.8]) and rows[0]["c"] == pytest.approx(0.96)
    assert rows[1]["n"] == [0.0, 0.0] and rows[1]["c"] == 0.0
