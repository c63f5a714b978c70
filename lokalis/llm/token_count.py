"""Token counts under a public byte-level BPE, cached by piece."""

from __future__ import annotations

import base64
from collections.abc import Iterable
from importlib.util import find_spec
from pathlib import Path

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = DEFAULT_RANKS) -> str:
    """Where the vocabulary file is installed; /opt/tokenizers where the package is not."""
    spec = find_spec("public_tokenizers")
    folder = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(folder / name)


class Counter:
    """Counts tokens. Text is cut at single blanks, where the pattern always cuts, so the count of a piece can be kept.

    Texts with runs of blanks or a blank at an end are encoded as they are, since there the cut would not be exact.
    """

    def __init__(self, path: str | None = None, most: int = 300_000):
        import tiktoken

        with open(path or default_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.most = most
        self.known = _Pieces(self)

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or text[-1] == " ":
            return len(self.encoding.encode_ordinary(text))
        first, *rest = text.split(" ")
        return len(self.encoding.encode_ordinary(first)) + sum(map(self.known.__getitem__, rest))

    def all(self, texts: Iterable[str]) -> list[int]:
        return [self(t) for t in texts]


class _Pieces(dict):
    def __init__(self, of: Counter):
        self.of = of

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.of.most:
            self.clear()
        n = self[piece] = len(self.of.encoding.encode_ordinary(" " + piece))
        return n
