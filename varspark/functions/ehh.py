"""Numpy kernels over a haplotype matrix (sites in order of position x haplotypes, 0/1)."""

from __future__ import annotations

import numpy as np

MIN_EHH, MAX_GAP, GAP_SCALE = 0.05, 200_000, 20_000


class Sweep:
    """Haplotypes in the order of what follows, site after site.

    After sites have been added, ``order`` has the haplotypes sorted by their alleles from the last added site back to the first, and lcp[k]
    tells on how many sites from the last added one the k-th and the next haplotype agree. A step costs the number of haplotypes, however far they agree.
    """

    def __init__(self, n: int):
        self.order, self.lcp = np.arange(n), np.zeros(n, np.int64)

    def subset(self, own: np.ndarray) -> np.ndarray:
        """Agreement of neighbours among the haplotypes own (a mask)."""
        at = np.flatnonzero(own[self.order])
        return np.minimum.reduceat(self.lcp, at)[:-1] if len(at) else self.lcp[:0]

    def add(self, alleles: np.ndarray) -> None:
        one = alleles[self.order] == 1
        order, lcp = [], []
        for at in (np.flatnonzero(~one), np.flatnonzero(one)):
            if len(at):
                order.append(self.order[at])
                own = np.minimum.reduceat(self.lcp, at) + 1
                own[-1] = 0
                lcp.append(own)
        self.order, self.lcp = np.concatenate(order), np.concatenate(lcp)


def pair_counts(lcp: np.ndarray) -> np.ndarray:
    """Of each agreement of neighbours, for how many pairs of haplotypes it is the smallest between them."""
    values = lcp.tolist()
    out, left, stack = [0] * len(values), [0] * len(values), []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            j = stack.pop()
            out[j] = left[j] * (k - j)
        left[k] = k - (stack[-1] if stack else -1)
        stack.append(k)
    while stack:
        j = stack.pop()
        out[j] = left[j] * (len(values) - j)
    return np.array(out, np.int64)


def area(lcp: np.ndarray, gaps: np.ndarray, min_ehh: float = MIN_EHH, max_gap: int = MAX_GAP, gap_scale: int = GAP_SCALE) -> float:
    """Area under extended haplotype homozygosity to one side; -1 where a gap is too wide.

    lcp: of a class of haplotypes, on how many sites beyond the focal one neighbours agree; gaps: from the focal site outwards.
    EHH at a site is the share of pairs that agree on every site from the focal one. Below min_ehh
    it counts as 0 and the walk ends; a gap wider than gap_scale counts as gap_scale.
    """
    size = min(len(gaps), int(lcp.max()) + 1)
    if not size:
        return 0.0
    pairs = len(lcp) * (len(lcp) + 1) // 2
    tail = np.bincount(np.minimum(lcp, size + 1), pair_counts(lcp), size + 2)[::-1].cumsum()[::-1]
    ehh = np.concatenate(([1.0], tail[1 : size + 1] / pairs))
    low = np.flatnonzero((ehh < min_ehh) | (ehh == 0))
    if len(low):
        ehh = ehh[: low[0] + 1].copy()
        ehh[-1] = 0
    gap = gaps[: len(ehh) - 1]
    if (gap > max_gap).any():
        return -1.0
    return float(((ehh[1:] + ehh[:-1]) / 2 * np.minimum(gap, gap_scale)).sum())


def areas(hap: np.ndarray, pos: np.ndarray, focal: np.ndarray, classes, **options) -> np.ndarray:
    """Areas to both sides added up, -1 where one is not valid, of the focal sites (ascending) and the classes that classes(alleles) gives, masks."""
    n, out = len(pos), None
    for forward in (True, False):
        sweep, turn = Sweep(hap.shape[1]), focal[::-1] if forward else focal
        gaps = np.diff(pos) if forward else np.diff(pos)[::-1]
        ahead, wanted = n - 1 if forward else 0, iter(turn.tolist())
        for f in wanted:
            while ahead > f if forward else ahead < f:
                sweep.add(hap[ahead])
                ahead += -1 if forward else 1
            beyond = gaps[f:] if forward else gaps[n - 1 - f :]
            got = []
            for own in classes(hap[f]):
                lcp = sweep.subset(own)
                got.append(area(lcp, beyond, **options) if len(lcp) else 0.0)
            if out is None:
                out = np.zeros((2, n, len(got)))
            out[0 if forward else 1, f] = got
    if out is None:
        return np.zeros((0, 1))
    return np.where((out < 0).any(axis=0), -1.0, out.sum(axis=0))[focal]


def integrated(hap: np.ndarray, pos: np.ndarray, focal: int, carriers: np.ndarray, min_ehh: float = MIN_EHH, max_gap: int = MAX_GAP, gap_scale: int = GAP_SCALE) -> float:
    """Area of one focal site and one class of haplotypes."""
    own = np.isin(np.arange(hap.shape[1]), carriers)
    return float(areas(hap, pos, np.array([focal]), lambda _: [own], min_ehh=min_ehh, max_gap=max_gap, gap_scale=gap_scale)[0, 0])


def run_sums(sweep: Sweep, alleles: np.ndarray) -> list[tuple[float, int]]:
    """Of the pairs with both alleles 0 and both 1: on how many sites they agree, this one included, added up, and their number. Adds the site to the sweep."""
    out = []
    for allele in (0, 1):
        lcp = sweep.subset(alleles == allele)
        pairs = len(lcp) * (len(lcp) + 1) // 2
        out.append((float((lcp * pair_counts(lcp)).sum()) + pairs, pairs))
    sweep.add(alleles)
    return out


def viterbi(pos: np.ndarray, af: np.ndarray, gt: np.ndarray, hw_to_az: float, az_to_hw: float, het_error: float) -> np.ndarray:
    """Most likely autozygous (1) or not (0) states, of all samples at once (sites x samples). gt below 0 is missing."""
    n, samples = gt.shape
    p = np.clip(af, 1e-3, 1 - 1e-3)[:, None]
    none = gt < 0
    pick = lambda a, b, c: np.where(none, 0.0, np.where(gt == 0, a, np.where(gt == 1, b, c)))
    emit = np.stack([pick(2 * np.log(1 - p), np.log(2 * p * (1 - p)), 2 * np.log(p)), pick(np.log(1 - p), np.log(het_error), np.log(p))])
    rate = hw_to_az + az_to_hw
    share = np.array([az_to_hw / rate, hw_to_az / rate])  # stationary
    score = np.log(share)[:, None] + emit[:, 0]
    back = np.zeros((n, 2, samples), np.int8)
    for i in range(1, n):
        moved = 1 - (1 - rate) ** float(pos[i] - pos[i - 1])
        leave = np.clip([share[1] * moved, share[0] * moved], 1e-10, 1 - 1e-10)  # of state 0, of state 1
        stay, go = score + np.log(1 - leave)[:, None], score[::-1] + np.log(leave[::-1])[:, None]
        back[i] = np.where(stay >= go, np.array([[0], [1]]), np.array([[1], [0]]))
        score = np.maximum(stay, go) + emit[:, i]
    path = np.empty((n, samples), np.int8)
    path[-1] = score[1] >= score[0]
    at = np.arange(samples)
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i], at]
    return path


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def garud(patterns: np.ndarray) -> tuple[float, float, float, float, int]:
    """h1, h12, h2/h1, haplotype diversity and distinct haplotypes of a matrix of sites x haplotypes."""
    n = patterns.shape[1]
    count = np.sort(np.unique(patterns, axis=1, return_counts=True)[1])[::-1]
    f = count / n
    h1 = float((f * f).sum())
    h12 = h1 + (2 * float(f[0] * f[1]) if len(f) > 1 else 0.0)
    return h1, h12, (h1 - float(f[0]) ** 2) / h1, (1 - h1) * n / (n - 1) if n > 1 else 0.0, len(f)
