"""RunSpec: the parameters of one run, validated once."""

from __future__ import annotations

import os
from dataclasses import dataclass


def slice_bounds(n: int, start: int | None, end: int | None) -> tuple[int, int]:
    """Half-open bounds of `seq[start:end]` over n rows; an empty slice gives (k, k)."""
    lo, hi, _ = slice(start, end).indices(n)
    return lo, max(lo, hi)


def batch_count(n: int, size: int) -> int:
    """Batches of `size` that n rows fill; the size must be at least 1."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    return -(-n // size)


@dataclass(frozen=True)
class RunSpec:
    """Input, output, slice, batch size and URL column of a run.

    Quotes around the input path are removed; a relative output lies beside the
    input; the batch size defaults to 64; a missing start or end means the whole table.
    """

    input_path: str
    output_path: str
    batch_size: int = 64
    start_row: int | None = None
    end_row: int | None = None
    url_column: str = "pdf_url"
    extract: bool = True
    annual_only: bool = False

    def __post_init__(self) -> None:
        path = self.input_path.strip("'\"")
        if not path:
            raise ValueError("an input path is needed")
        if not self.output_path:
            raise ValueError("an output path is needed")
        if self.batch_size < 1:
            raise ValueError("batch size must be at least 1")
        if not self.url_column:
            raise ValueError("a URL column is needed")
        object.__setattr__(self, "input_path", path)
        object.__setattr__(self, "output_path", os.path.join(os.path.dirname(path), self.output_path))

    def bounds(self, n: int) -> tuple[int, int]:
        return slice_bounds(n, self.start_row, self.end_row)

    def batches(self, n: int) -> int:
        lo, hi = self.bounds(n)
        return batch_count(hi - lo, self.batch_size)
