"""What a worker keeps of the words that it has met."""

from __future__ import annotations

from ladderlens.llm import tokens


def test_a_plain_word_is_kept_once():
    """The word's own entry and that of its core share the string and the ids; other forms have the same ids."""
    encoder = tokens.WordEncoder(tokens.default_path())
    encoder.encode([b"zebrawood Zebrawood zebrawood. qwxyzzy"])
    own, core = ({k: k for k in x} for x in (encoder.words, encoder.cores))
    for word in ("zebrawood", "qwxyzzy"):
        assert own[word] is core[word] and encoder.words[word] is encoder.cores[word]
    assert encoder.words["Zebrawood"] == encoder.words["zebrawood"]
