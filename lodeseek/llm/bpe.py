"""Byte-pair merges of single pre-tokens, for vocabularies in the tokenizers library's format.

The merges run in tiktoken's core, which joins the adjacent pair whose joined bytes have the lowest rank. That gives
the library's own result as long as every string in the ranks encodes alone to itself: when such a pair is joined,
nothing has crossed the string's ends, so what happened inside is what happens to the string alone, and the pair is
the library's own last merge. ``unreachable`` finds the strings for which this fails; they are left out of the ranks.

A vocabulary with a mark for the end of a word ("</w>") has the byte 0xFF, which no UTF-8 text holds, in its place;
a last byte with its mark is a base symbol there, of lower rank than any merge, so it is joined first here too.
"""

from __future__ import annotations

import json
from functools import lru_cache

from lodeseek.llm.common import tokenizer_file

MARK = b"\xff"


@lru_cache(1)
def byte_of() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies, by its rule: printable bytes stand for
    themselves, all others for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + n)] = b
            n += 1
    return out


@lru_cache(4)
def parts(vocabulary: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """Ranks by bytes, and merges (pairs of bytes) by their order."""
    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        whole = json.load(f)
    model, of = whole["model"], byte_of()
    end = model.get("end_of_word_suffix") or ""
    special = {x["content"] for x in whole["added_tokens"]}

    def raw(token: str) -> bytes:
        marked = bool(end) and token.endswith(end)
        return bytes(of[c] for c in (token[: -len(end)] if marked else token)) + MARK * marked

    merges = {}
    for i, pair in enumerate(model["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        merges[raw(a), raw(b)] = i
    return {raw(t): i for t, i in model["vocab"].items() if t not in special}, merges


def require(vocabulary: str, normalizer: list[str], pre_tokenizers: list[tuple[str, str | None]]) -> None:
    """Raises unless the file's normaliser and pre-tokenizers, by type (and pattern), are these: other rules cut texts elsewhere."""
    with open(tokenizer_file(vocabulary), encoding="utf-8") as f:
        whole = json.load(f)
    flat = lambda one, name: [] if one is None else one.get(name, []) if one["type"] == "Sequence" else [one]
    found = [x["type"] for x in flat(whole["normalizer"], "normalizers")], [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in flat(whole["pre_tokenizer"], "pretokenizers")]
    if found != (normalizer, pre_tokenizers) or whole["model"]["type"] != "BPE" or any(x.get("add_prefix_space") for x in flat(whole["pre_tokenizer"], "pretokenizers")):
        raise ValueError(f"{vocabulary} has other rules than this operator knows: {found}")


def merged_alone(data: bytes, merges: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The library's own rule, plainly: the pair with the earliest merge first, the leftmost of equals."""
    body = data.removesuffix(MARK) if len(data) > 1 else data
    now = [bytes([c]) for c in body]
    if len(body) < len(data):
        now[-1] += MARK
    while len(now) > 1:
        best = min(range(len(now) - 1), key=lambda i: merges.get((now[i], now[i + 1]), 1 << 60))
        if (now[best], now[best + 1]) not in merges:
            break
        now[best : best + 2] = [now[best] + now[best + 1]]
    return now


@lru_cache(4)
def unreachable(vocabulary: str) -> frozenset[bytes]:
    """Vocabulary strings that do not encode alone to themselves."""
    ranks, merges = parts(vocabulary)
    return frozenset(x for x in ranks if len(merged_alone(x, merges)) > 1)


@lru_cache(4)
def encoder(vocabulary: str, without: frozenset[bytes] = frozenset()):
    """A function from the bytes of one pre-token (with its mark, if the vocabulary has one) to its ids."""
    import tiktoken

    ranks, _ = parts(vocabulary)
    ranks = {x: i for x, i in ranks.items() if x not in without}
    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
