from lumendex.functions.analysis import STOPWORDS


def test_whole_lists():
    """Distinct words of the reference's files."""
    n = {"arabic": 243, "danish": 94, "dutch": 101, "english": 174, "finnish": 229, "french": 154, "german": 231, "hungarian": 198, "indonesian": 93, "italian": 279, "norwegian": 172, "portuguese": 203, "russian": 159, "spanish": 308, "swedish": 114}
    assert {k: len(set(v)) for k, v in STOPWORDS.items()} == n and all(len(v) == n[k] for k, v in STOPWORDS.items())
    assert {"yourselves", "wouldn't", "i", "very"} <= set(STOPWORDS["english"]) and {"и", "чтобы"} <= set(STOPWORDS["russian"])
