"""Text cutting. Each cut depends on the previous one, so these few helpers run
per text inside Arrow batches; everything around them stays in the JVM."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: sizes -------------------------------------------------------
CHUNK_CHARS = 1500
CHUNK_OVERLAP = 200
MAX_CHUNKS = 40  # storage cap of the original catalogue; off by default so whole texts are kept
BLOCK_CHARS = 12_000
BATCH_CHARS = 48_000
ANCHOR_RADIUS = 500
# a piece is cut at a gap only past this share of its size
CHUNK_SHARE, BLOCK_SHARE = 0.8, 0.6

# --- fixed values: anchors of commercial fields ----------------------------------
# Letters and digits are spelled out because Python's \w and \d also match other alphabets.
ANCHORS = [
    r"prazo\s+(?:m[áa]ximo\s+)?(?:de|para)\s+(?:a\s+)?entrega",
    r"prazo\s+(?:de|para)\s+(?:o\s+)?pagamento|pagamento\s+ser[áa]\s+(?:efetuado|realizado)",
    r"validade\s+(?:m[íi]nima\s+)?da\s+proposta",
    r"pregoeir[oa]|agente\s+de\s+contrata[çc][ãa]o",
    r"telefone|fone\s*:|\([0-9]{2}\)\s*[0-9]{4,5}-?[0-9]{4}",
    r"e-?mail|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+",
    r"local\s+(?:de\s+)?entrega|endere[çc]o|situad[oa]\s+(?:na|no|à)",
]
TYPE_ORDER = {"edital": 0, "anexo": 1, "outro": 2, "projeto": 3, "orcamento": 4}


#: Characters of texts that are Python objects at a time.
SLICE = 1 << 20


def _per_text(schema: str, kind: pa.DataType, cut: Callable[[str], list]) -> Callable[[Column], Column]:
    """``cut`` of every text; a batch is taken in slices, so that its memory does not follow its rows."""

    @F.arrow_udf(schema)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done, held, size = [], [], 0
            for t in texts:
                raw = t.as_py()
                held.append(None if raw is None else cut(raw))
                size += len(raw or "")
                if size >= SLICE:
                    done.append(pa.array(held, kind))
                    held, size = [], 0
            yield pa.concat_arrays([*done, pa.array(held, kind)])

    return apply


def _spans(length: int, stops: list[int], reach: int, least: float, lap: int = 0) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text of ``length`` characters, given its sorted ``stops``.

    A piece is ``reach`` characters at most. It ends at the last stop that leaves
    it longer than ``least``, at its full reach if there is none, and the next one
    begins ``lap`` before that end, one character further on at least.
    """
    spans = [(0, 0)]
    while spans[-1][1] < length:
        begin = max(spans[-1][0] + 1, spans[-1][1] - lap) if spans[-1][1] else 0
        last = bisect_right(stops, begin + reach) - 1
        at_stop = last >= 0 and stops[last] > begin + least
        spans.append((begin, length if begin + reach >= length else stops[last] if at_stop else begin + reach))
    return spans[1:]


def chunk_overlap(
    text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, max_chunks: int | None = None
) -> Column:
    """Overlapping chunks ending at a space when one lies in the last fifth.

    ``overlap`` is held below ``size`` and every step moves forward. All of the
    text is covered unless the caller sets ``max_chunks``.
    """

    def cut(raw: str) -> list[str]:
        body = raw.strip()
        spaces = [m.start() for m in re.finditer(" ", body)]
        made = (body[a:b].strip() for a, b in _spans(len(body), spaces, size, CHUNK_SHARE * size, min(overlap, size - 1)))
        return [piece for piece in made if piece][:max_chunks]

    return _per_text("array<string>", pa.list_(pa.string()), cut)(text)


def split_lossless(text: Column, cap: int = BLOCK_CHARS) -> Column:
    """Blocks whose concatenation is the text, cut after a line end or space past 60%."""
    if cap < 2:
        raise ValueError("a block needs room for at least 2 characters")

    def cut(raw: str) -> list[str]:
        after_gap = [m.end() for m in re.finditer("[ \n]", raw)]
        return [raw[a:b] for a, b in _spans(len(raw), after_gap, cap, int(BLOCK_SHARE * cap))]

    return _per_text("array<string>", pa.list_(pa.string()), cut)(text)


def anchor_spans(text: Column, patterns: list[str] | None = None) -> Column:
    """array<struct<pattern, start, end>> of every match, 0-based, end exclusive."""
    compiled = [re.compile(p, re.IGNORECASE) for p in (patterns or ANCHORS)]

    def find(raw: str) -> list[dict]:
        return [
            {"pattern": i, "start": m.start(), "end": m.end()}
            for i, rx in enumerate(compiled)
            for m in rx.finditer(raw)
        ]

    span = pa.struct([("pattern", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    return _per_text("array<struct<pattern:int,start:int,end:int>>", pa.list_(span), find)(text)


def anchor_count(text: Column, pattern: str) -> Column:
    """Number of matches of one pattern, without leaving the JVM."""
    return F.regexp_count(text, F.lit(pattern))
