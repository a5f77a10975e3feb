"""The validated settings of an imputation."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = ("diploid", "pseudoHaploid", "diploid-inbred")


@dataclass(frozen=True)
class Config:
    """Names and defaults follow the usual ones of the field; ``check`` raises ValueError on the first broken rule. There is no setting
    without effect."""

    K: int
    nGen: float
    S: int = 1
    method: str = "diploid"
    niterations: int = 40
    switchModelIteration: int | None = None
    refillIterations: tuple[int, ...] = (6, 10, 14, 18)
    shuffleHaplotypeIterations: tuple[int, ...] = (4, 8, 12, 16)
    splitReadIterations: tuple[int, ...] = ()
    shuffle_bin_radius: int = 5000
    reference_iterations: int = 40
    reference_shuffleHaplotypeIterations: tuple[int, ...] = (4, 8, 12, 16)
    reference_phred: int = 20
    expRate: float = 0.5
    minRate: float = 0.1
    maxRate: float = 100.0
    emissionThreshold: float = 1e-4
    alphaMatThreshold: float = 1e-4
    maxDifferenceBetweenReads: float = 1000.0
    bqFilter: int = 17
    useSoftClippedBases: bool = False
    iSizeUpperLimit: int = 600
    downsampleToCov: float = 50.0
    downsampleFraction: float = 1.0
    downsampleSamples: float = 1.0
    gridWindowSize: int | None = None
    regionStart: int | None = None
    regionEnd: int | None = None
    buffer: int | None = None
    output_format: str = "bgvcf"
    outputSNPBlockSize: int = 10_000
    output_haplotype_dosages: bool = False
    readAware: bool = True
    do_phasing: bool = False
    seed: int = 1

    def check(self) -> Config:
        def need(right: bool, message: str) -> None:
            if not right:
                raise ValueError(message)

        need(isinstance(self.K, int) and self.K >= 1, "K must be a positive integer")
        need(isinstance(self.S, int) and self.S >= 1, "S must be a positive integer")
        need(self.nGen >= 0, "nGen must not be negative")
        need(self.method in METHODS, f"method must be one of {', '.join(METHODS)}")
        need(self.niterations >= 1, "niterations must be at least 1")
        need(all(i <= self.niterations - 5 for i in self.refillIterations) or self.niterations < 6, "refill iterations must be at least 5 before the last")
        need(all(i <= self.niterations - 5 for i in self.shuffleHaplotypeIterations) or self.niterations < 6, "shuffle iterations must be at least 5 before the last")
        need(self.reference_iterations >= 0 and self.reference_phred > 0, "reference_iterations must not be negative, reference_phred must be positive")
        need(self.reference_iterations < 6 or all(i <= self.reference_iterations - 5 for i in self.reference_shuffleHaplotypeIterations), "reference shuffle iterations must be at least 5 before the last")
        need(all(i < self.niterations for i in self.splitReadIterations), "reads can't be split in the last iteration")
        need(not self.splitReadIterations or self.S == 1, "splitting reads needs S = 1")
        need(self.shuffle_bin_radius > 0, "shuffle_bin_radius must be positive")
        need(0 <= self.downsampleFraction <= 1, "downsampleFraction must be from 0 to 1")
        need(0 < self.downsampleSamples <= 1, "downsampleSamples must be above 0 and at most 1")
        need(self.gridWindowSize is None or self.gridWindowSize >= 2, "gridWindowSize must be at least 2")
        given = [x is not None for x in (self.regionStart, self.regionEnd, self.buffer)]
        need(all(given) or not any(given), "regionStart, regionEnd and buffer go together")
        need(not all(given) or 0 < self.regionStart <= self.regionEnd and self.buffer >= 0, "regionStart must be positive and at most regionEnd")
        need(self.output_format in ("bgvcf", "bgen"), "output_format must be bgvcf or bgen")
        need(not self.output_haplotype_dosages or self.S == 1 and self.output_format == "bgvcf", "haplotype dosages need S = 1 and bgvcf")
        need(self.outputSNPBlockSize >= 1, "outputSNPBlockSize must be at least 1")
        need(self.maxDifferenceBetweenReads >= 1, "maxDifferenceBetweenReads must be at least 1")
        need(0 < self.alphaMatThreshold < 1 and 0 < self.emissionThreshold < 0.5, "thresholds must be small shares")
        need(not self.do_phasing or self.S == 1, "phasing needs S = 1")
        return self
