"""The piece vocabulary of a SentencePiece model file, and texts in its terms.

The space mark of the file is read as a plain space, so texts are used as they are, and a literal mark in a text is a character like any
other that no piece holds. A text gets one space in front. White space is kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


@dataclass(frozen=True)
class Pieces:
    """ids: piece to id; scores: by id; byte_ids: 256 ids of the single bytes; longest: characters; unknown: score of a character in no piece; unit: finds a text's units."""

    ids: dict[str, int]
    scores: list[float]
    byte_ids: list[int]
    longest: int
    unknown: float
    unit: re.Pattern

    def text(self) -> list[str]:
        """Piece texts by id; bytes and control pieces are ''."""
        out = [""] * len(self.scores)
        for p, i in self.ids.items():
            out[i] = p
        return out


def load(path: str = MODEL) -> Pieces:
    """Reads the vocabulary on the driver; tasks get it with their closure, its size is that of the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    scores = [model.get_score(i) for i in range(n)]
    ids = {}
    for i in range(n):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[model.id_to_piece(i).replace(MARK, " ")] = i
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    inner = [p for p in ids if re.search(r"[^ ] |\n", p)]
    if inner:
        raise ValueError(f"pieces that cross a word start: {inner[:3]}")
    return Pieces(ids, scores, byte_ids, max(map(len, ids)), min(scores[i] for i in ids.values()) - 10, UNIT if any(map(MIXED.search, ids)) else FINE)


#: Every segmentation has boundaries before a space that follows another character and about a line feed; between them lie the units.
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")

#: Where no piece has a Latin letter beside an ASCII digit or mark, such places are boundaries, too; words with marks are then few units instead of many.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-@\[-`{-~"
MIXED = re.compile(f"[{_LETTER}][{_MARK}]|[{_MARK}][{_LETTER}]")
_RUN = f"(?:[{_LETTER}]+|[{_MARK}]+)"
_REST = f"(?:[^ \n{_LETTER}{_MARK}]+{_RUN}?)"
FINE = re.compile(rf"\n| +{_RUN}?{_REST}*|{_RUN}{_REST}*|{_REST}+")
