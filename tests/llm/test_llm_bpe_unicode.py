"""Pre-tokens at every code point, and ids around those that other Unicode tables class differently."""

import pytest
import regex
from tokenizers import Tokenizer, pre_tokenizers

from skylattice.llm import bpe, queries

VOCABULARY = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
LIBRARY = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
PLANES = [(0x10000 * p, 0x10000 * (p + 1)) for p in range(17)]


def library_cuts(text):
    return [text[a:b] for _, (a, b) in LIBRARY.pre_tokenize_str(text)]


def characters(first, last):
    return [chr(c) for c in range(first, last) if not 0xD800 <= c < 0xE000]


@pytest.mark.parametrize("first,last", [(0, 0x250), (0x250, 0x10000), *PLANES[1:4], PLANES[14]])
def test_every_code_point_beside_a_letter_a_digit_and_a_sign(first, last):
    text = "\n".join(f"a{c}1{c}!{c} {c}b" for c in characters(first, last))
    assert bpe.Bpe.split(text) == library_cuts(text)


def test_the_other_planes_hold_signs_alone():
    for first, last in (*PLANES[4:14], *PLANES[15:]):
        text = "a" + "".join(characters(first, last)) + "1"
        assert not regex.search(r"[\p{L}\p{N}\s]", text[1:-1])
        assert bpe.Bpe.split(text) == library_cuts(text) == ["a", text[1:-1], "1"]


def test_ids_around_characters_newer_than_the_library():
    ours, library = bpe.Bpe(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    newer = [c for c in characters(0, 0x40000) if bpe._NEWER.match(c)]
    assert len(newer) == 17480
    texts = ["\U0001df36擭"] + [f"word{c}word {c}{c} 12{c}3, {c}擭" for c in newer]
    for text, said in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text) == said.ids
        assert ours.decode(said.ids) == text
