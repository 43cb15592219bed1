from lumendex.operators import spelling


def test_swaps_in_words_of_two_and_three_letters(spark):
    """'teh' and 'the' share no fragment as spelt, 'fo' and 'of' neither; a word of four has no such forms."""
    known = spark.createDataFrame([("the", 50), ("of", 40), ("zig", 5), ("abcd", 9)], "word string, freq long")
    asked = spark.createDataFrame([(w,) for w in ("teh", "hte", "fo", "izg", "zgi", "abdc", "qq")], "word string")
    for most in (1, 2):
        got = {r.word: r.suggestion for r in spelling.suggestions(known, asked, most).collect()}
        assert got == {"teh": "the", "hte": "the", "fo": "of", "izg": "zig", "zgi": "zig", "abdc": "abcd", "qq": None}
