from lumendex.functions.stem import stem


def test_english_regions_and_exceptions():
    """By hand from the reference's english.sbl."""
    for w, s in {
        "internal": "internal", "intern": "intern", "international": "internat", "interval": "interval", "evening": "evening", "evenings": "evening",
        "pasted": "paste", "pasting": "paste", "paste": "paste", "past": "past", "even": "even", "winter": "winter", "'only": "on",
    }.items():
        assert stem(w, "english") == s, w
