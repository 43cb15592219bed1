"""Plain texts are cut at blanks; only what lies between two blanks and is not known is cut into words, once."""

import re
from types import SimpleNamespace

from lumendex.llm import packing


def test_a_run_is_cut_once_and_ids_are_the_librarys(monkeypatch):
    e, cut, words = packing.Encoder(packing.default_path()), [], packing._WORDS
    monkeypatch.setattr(packing, "_WORDS", SimpleNamespace(findall=lambda t: cut.append(t) or words.findall(t)))
    texts = ["It's here, it's HERE, there", "here, it's\there\x0bÉté ª x2 '''s ((a))", "", " ", "<|x|> here,", "日本 here,"] * 3
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.library.encode(t, add_special_tokens=False).ids
    assert sorted(cut) == sorted({"it's", "here,", "x2", "'''s", "((a))"})
    assert not any(re.search(r"\s", t) for t in e.known) and "here," not in e.known and "here" in e.known
