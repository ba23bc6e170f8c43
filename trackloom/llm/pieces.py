"""A SentencePiece vocabulary read as a unigram model, loaded inside tasks from a path that is a parameter."""

from __future__ import annotations

from functools import lru_cache

import sentencepiece

#: The file marks runs of spaces by scores below this.  Runs of several are not part of the unigram model; a single one takes the lowest score of the rest.
LEAST_SCORE = -1e6
#: An unknown character costs so much more than the worst piece.
UNKNOWN_COST = 10.0

SPACE = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """piece -> (score, id) of the ordinary pieces; ids of the byte pieces; the bytes and the piece of every id."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normal: dict[str, tuple[float, int]] = {}
        self.byte: dict[int, int] = {}
        self.bytes_of: list[bytes] = []
        self.text_of: list[str] = []
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            out = b""
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                out = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                out = piece.replace(SPACE, " ").encode()
                if score > LEAST_SCORE or piece == SPACE:
                    self.normal[piece] = (score, i)
            # what stays b"" is never produced by encoding
            self.bytes_of.append(out)
            self.text_of.append(piece)
        if SPACE in self.normal:
            self.normal[SPACE] = (min(s for s, _ in self.normal.values() if s > LEAST_SCORE), self.normal[SPACE][1])
        self.unknown = min(s for s, _ in self.normal.values()) - UNKNOWN_COST
        self.longest = max(map(len, self.normal))
        if len(self.byte) < 256:
            raise ValueError("the vocabulary needs all byte pieces")
        if any(SPACE in p[1:] for p in self.normal):
            raise ValueError("a piece crosses a space")

    def ids_of_unknown(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]


@lru_cache(maxsize=4)
def load(path: str | None) -> Pieces:
    return Pieces(path or default_path())


def chunks(text: str) -> list[str]:
    """The text as the model sees it (a space in front, spaces as U+2581), cut before each U+2581: no piece crosses a cut."""
    return [SPACE + p for p in text.replace(SPACE, " ").split(" ")] if text else []


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of ids: bytes joined, without the space in front."""
    raw = b"".join(map(pieces.bytes_of.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")
