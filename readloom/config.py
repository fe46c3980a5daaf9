"""Parameters of an assembly, and those that follow from the reads' average length."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    scale: float = 0.55
    trim_left: int = 3
    trim_right: int = 3
    drop_n: bool = True  #: drop reads with an unknown base; else fill it in
    rna: bool = False
    max_period: int = 20  #: reads of a period up to this are dropped
    min_overlap: int = 0  #: 0: from the average length
    small_overlaps_kept: int = 3
    max_overlap: int = 500
    new_reads_percent: int = 95
    end_coverage: int = 3  #: consensus ends with no more votes than this are cut
    mate_support: int = 5
    insert_size: int = 1000
    trim_overlap: int = 25
    error_rate: float = 0.0
    # Derived:
    average_length: float = 0.0
    transitive_from: int = 0  #: overlaps of this size on remove transitive edges
    min_contig: int = 200
    max_parallel_offset: int = 250
    max_dangling_offset: int = 250
    kmer: int = 0
    kmer_intervals: int = 3

    @property
    def min_read(self) -> int:
        return self.kmer_intervals + self.kmer


def derive(p: Params, average_length: float) -> Params:
    """p with what depends on the average read length; without reads (length 0) the fixed minima hold."""
    full = int(average_length) + p.trim_left + p.trim_right
    least = p.min_overlap or int(full * p.scale)
    transitive = (least + full) // 2 if p.min_overlap else int(full * (p.scale + 1) / 2)
    long = int(1.75 * full)
    return replace(p, average_length=average_length, min_overlap=least, transitive_from=transitive, kmer=min(2 * least // 3, 60), min_contig=max(200, long), max_parallel_offset=max(250, long), max_dangling_offset=max(250, long))


def supplement(p: Params) -> Params:
    """For the approximate overlaps between tips."""
    return replace(p, min_overlap=int((1 + p.scale) * p.average_length / 2), kmer=35, kmer_intervals=6)
