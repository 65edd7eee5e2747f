"""Word and token helpers that the Python operators share."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_ALNUM = b"0123456789" + LOWER

#: A-Z to a-z; all other bytes stay.
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)
#: The same, and every ASCII byte outside 0-9 and a-z to a space. Bytes from 0x80 up
#: belong to words, so ``text.translate(ALNUM_ONLY).split()`` finds the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
ALNUM_ONLY = bytes(
    b if b >= 0x80 or b in _ALNUM else b + 32 if b in UPPER else 0x20 for b in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and all non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ALNUM_ONLY).split()


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


#: White space that both libraries below count as such, in runs longer than regular expressions may back out of.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def byte_ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """Ids by bytes of a byte-level BPE ``tokenizers`` file, given as its JSON, if the ids are
    the order of its merges: then merging by the smallest id is merging by the first rule.

    (The other condition is that each token is its own encoding, which tests show of the files
    in use: a pair that makes up a token without being its rule then never stands alone.)"""
    model, pre = vocabulary["model"], vocabulary["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or vocabulary["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    ids = model["vocab"]
    merged = [ids["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letter = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in vocabulary["added_tokens"]}
    return {bytes(letter[c] for c in token): n for token, n in ids.items() if token not in special}


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    """``text -> uint32 ids`` of the ``tokenizers`` file.

    A byte-level BPE whose ids are its merge order (see :func:`byte_ranks`) is run by ``tiktoken``
    on the same vocabulary, which takes a quarter of the time. Its regular expression fails on very
    long white space, so a text is cut there: a run of white space is one piece up to its last
    character, which belongs to what follows, if anything does."""
    with open(path, encoding="utf-8") as f:
        ranks = byte_ranks(json.load(f))
    if ranks:
        import public_tokenizers
        import tiktoken

        core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def run(text: str) -> np.ndarray:
            parts, at = [], 0
            for m in _LONG_BLANK.finditer(text):
                upto = m.end() if m.end() == len(text) else m.end() - 1
                parts += [core.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(core._encode_single_piece(text[m.start() : upto].encode()))]
                at = upto
            parts.append(core.encode_to_numpy(text[at:] if at else text, disallowed_special=()))
            return (np.concatenate(parts) if at else parts[0]).astype(np.uint32, copy=False)

        return run
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def vocabulary_size(path: str) -> int:
    """One more than the largest id of the ``tokenizers`` file, its added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1


def encode(path: str, text: str | None) -> np.ndarray:
    """Token ids of the whole text; names of special tokens in it are ordinary text."""
    return _encoder(path)(text) if text else np.empty(0, dtype=np.uint32)
