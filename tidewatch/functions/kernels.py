"""Numerical kernels on arrays: no Spark in here."""

from __future__ import annotations

import math

import numpy as np

MAD_SCALE = 1.482602218505602  # fixed value: 1 / quantile of the normal distribution at 3/4
#: Autocorrelation that a detected period needs.
FLOOR = 0.3
#: Excesses that a tail fit needs.
LEAST_PEAKS = 10


def filled(x: np.ndarray) -> np.ndarray:
    """Gaps bridged linearly, ends held."""
    ok = ~np.isnan(x)
    if ok.all() or not ok.any():
        return x.copy()
    at = np.arange(len(x))
    return np.interp(at, at[ok], x[ok])


def trailing_mean(x: np.ndarray, w: int) -> np.ndarray:
    """Mean of the last ``w`` values, of fewer at the beginning."""
    total = np.r_[0.0, np.cumsum(x)]
    end = np.arange(1, len(x) + 1)
    start = np.maximum(0, end - w)
    return (total[end] - total[start]) / (end - start)


def detect_period(x: np.ndarray) -> int:
    """The lag of the highest local peak of the autocorrelation, which must reach ``FLOOR``."""
    x = np.asarray(x, float)
    if (~np.isnan(x)).sum() < 4:
        raise ValueError("too few values to detect a period")
    x = np.where(np.isnan(x), np.nanmean(x), x)
    x = x - x.mean()
    if not np.any(np.abs(x) > 0):
        raise ValueError("a constant series has no period")
    n = len(x)
    spectrum = np.abs(np.fft.rfft(x, 2 * n)) ** 2
    acf = np.fft.irfft(spectrum)[: n // 2 + 2]
    acf = acf / acf[0]
    inner = acf[1:-1]
    peak = np.flatnonzero((inner > acf[:-2]) & (inner > acf[2:]) & (inner >= FLOOR)) + 1
    peak = peak[(peak >= 2) & (peak <= n // 2)]
    if not len(peak):
        raise ValueError("no period stands out; name one")
    return int(peak[np.argmax(acf[peak])])


# Student's t, by the incomplete beta function


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_quantile(p: float, df: float) -> float:
    """Inverse distribution function of Student's t for p above 1/2, by bisection on x = df / (df + t^2)."""
    tail = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_ratio(df / 2.0, 0.5, mid) < tail else (low, mid)
        if high - low <= 1e-17 * max(high, 1e-300):
            break
    x = (low + high) / 2
    return math.sqrt(df * (1.0 - x) / x) if x > 0 else math.inf


def esd_critical(n: int, alpha: float) -> float:
    """Largest deviation, in standard deviations, that ``n`` values are allowed (generalised ESD, one step)."""
    if n < 3:
        return math.inf
    df = n - 2
    t = t_quantile(1.0 - alpha / (2.0 * n), df)
    return t * (n - 1) / math.sqrt((df + t * t) * n)


def esd_survivors(x: np.ndarray, alpha: float) -> tuple[int, float, float]:
    """Number, sum and sum of squares of what is left when the farthest value is taken off while it is too far.

    The sums are of differences to nothing: plain values, as applying needs them."""
    x = np.sort(x[np.isfinite(x)])
    low, high = 0, len(x)
    shift = float(x.mean()) if len(x) else 0.0
    y = x - shift
    total, squares = float(y.sum()), float((y * y).sum())
    drop_to = (low, high)
    while high - low >= 3:
        n = high - low
        mean = total / n
        var = max((squares - total * total / n) / (n - 1), 0.0)
        if var <= 0:
            break
        far_low, far_high = mean - y[low], y[high - 1] - mean
        far = max(far_low, far_high) / math.sqrt(var)
        if far <= esd_critical(n, alpha):
            break
        gone = y[low] if far_low > far_high else y[high - 1]
        low, high = (low + 1, high) if far_low > far_high else (low, high - 1)
        total, squares = total - gone, squares - gone * gone
        drop_to = (low, high)
    kept = x[drop_to[0] : drop_to[1]]
    return len(kept), float(kept.sum()), float((kept * kept).sum())


# generalised Pareto tails


def gpd_likelihood(y: np.ndarray, shape: float, scale: float) -> float:
    if scale <= 0:
        return -math.inf
    if abs(shape) < 1e-12:
        return -len(y) * math.log(scale) - float(y.sum()) / scale
    z = 1.0 + shape * y / scale
    if (z <= 0).any():
        return -math.inf
    return -len(y) * math.log(scale) - (1.0 + 1.0 / shape) * float(np.log(z).sum())


def gpd_fit(y: np.ndarray) -> tuple[float, float]:
    """Shape and scale of largest likelihood.

    With theta = shape / scale the likelihood depends on theta alone: shape(theta) = mean log(1 + theta y).  Its
    stationary points are bracketed on a grid on either side of zero and bisected; the exponential is always tried."""
    y = np.asarray(y, float)
    mean, top = float(y.mean()), float(y.max())
    best = (gpd_likelihood(y, 0.0, mean), 0.0, mean)

    def slope(theta: float) -> float:
        z = 1.0 + theta * y
        return (1.0 + float(np.log(z).mean())) * float((1.0 / z).mean()) - 1.0

    eps = 1e-8 / mean
    left = np.linspace(-1.0 / top + eps, -eps, 41) if 1.0 / top > 2 * eps else np.array([])
    right = np.r_[np.geomspace(eps, 2.0 / mean, 30), np.geomspace(2.0 / mean, 1e3 / mean, 20)[1:]]
    for grid in (left, right):
        values = [slope(t) for t in grid]
        for a, b, fa, fb in zip(grid, grid[1:], values, values[1:], strict=False):
            if fa == 0 or fa * fb < 0:
                low, high, f_low = a, b, fa
                for _ in range(100):
                    mid = (low + high) / 2
                    f = slope(mid)
                    low, high, f_low = (mid, high, f) if f * f_low > 0 else (low, mid, f_low)
                theta = (low + high) / 2
                shape = float(np.log1p(theta * y).mean())
                if shape != 0 and theta != 0 and (like := gpd_likelihood(y, shape, shape / theta)) > best[0]:
                    best = (like, shape, shape / theta)
    return best[1], best[2]


def pot_fence(start: float, shape: float, scale: float, conditional: float) -> float:
    """The level that an excess passes with probability ``conditional``."""
    if abs(shape) < 1e-12:
        return start - scale * math.log(conditional)
    return start + scale / shape * (conditional**-shape - 1.0)


# change points


def prefix_costs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]


def segment_cost(x: np.ndarray, sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, stop: int, cost: str) -> np.ndarray:
    """Cost of the segments [start, stop): squared distance to the mean, or distance to the median."""
    if cost == "l2":
        n = stop - starts
        s = sums[0][stop] - sums[0][starts]
        return np.maximum(sums[1][stop] - sums[1][starts] - s * s / n, 0.0)
    return np.array([np.abs(x[a:stop] - np.median(x[a:stop])).sum() for a in starts])


def default_penalty(x: np.ndarray, cost: str) -> float:
    """Scaled by the noise that differences of neighbours show."""
    n = len(x)
    if n < 3:
        return 0.0
    sigma = MAD_SCALE * float(np.median(np.abs(np.diff(x)))) / math.sqrt(2.0)
    return 2.0 * (sigma * sigma if cost == "l2" else sigma) * math.log(n)


def pelt(x: np.ndarray, cost: str = "l2", penalty: float | None = None, min_size: int = 2, jump: int = 1) -> list[int]:
    """First rows of all segments but the first, at least total cost plus penalty per change; exact."""
    n = len(x)
    if n < 2 * min_size:
        return []
    beta = default_penalty(x, cost) if penalty is None else penalty
    x = x - x.mean()
    sums = prefix_costs(x)
    best, last = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -beta
    open_ = np.array([0])
    ends = [e for e in range(min_size, n) if e % jump == 0] + [n]
    fresh: list[int] = []
    for end in ends:
        ready = [s for s in fresh if end - s >= min_size]
        fresh = [s for s in fresh if end - s < min_size]
        open_ = np.r_[open_, np.array(ready, int)]
        able = open_[end - open_ >= min_size]
        totals = best[able] + segment_cost(x, sums, able, end, cost)
        k = int(np.argmin(totals))
        best[end], last[end] = totals[k] + beta, able[k]
        open_ = able[totals <= best[end] + 1e-12]
        fresh.append(end)
    out, end = [], n
    while last[end] > 0:
        end = int(last[end])
        out.append(end)
    return out[::-1]


def gain(x: np.ndarray, sums: tuple, a: int, b: int, cost: str, min_size: int) -> tuple[float, int]:
    """Best split of [a, b): what it saves, and where."""
    if b - a < 2 * min_size:
        return -math.inf, -1
    cuts = np.arange(a + min_size, b - min_size + 1)
    whole = segment_cost(x, sums, np.array([a]), b, cost)[0]
    left = np.array([segment_cost(x, sums, np.array([a]), int(c), cost)[0] for c in cuts])
    saved = whole - left - segment_cost(x, sums, cuts, b, cost)
    k = int(np.argmax(saved))
    return float(saved[k]), int(cuts[k])


def search_changes(x: np.ndarray, model: str, cost: str = "l2", penalty: float | None = None, n_bkps: int | None = None, min_size: int = 2, width: int = 100) -> list[int]:
    """Changes by binary segmentation, bottom-up merging, dynamic programming or a sliding window."""
    n = len(x)
    if n < 2 * min_size:
        return []
    beta = default_penalty(x, cost) if penalty is None else penalty
    x = x - x.mean()
    sums = prefix_costs(x)
    one = lambda a, b: float(segment_cost(x, sums, np.array([a]), b, cost)[0])
    if model == "dynp":
        if n_bkps is None:
            return pelt(x, cost, beta, min_size)
        best = np.full((n_bkps + 1, n + 1), np.inf)
        back = np.zeros((n_bkps + 1, n + 1), int)
        for e in range(min_size, n + 1):
            best[0, e] = one(0, e)
        for k in range(1, n_bkps + 1):
            for e in range((k + 1) * min_size, n + 1):
                starts = np.arange(k * min_size, e - min_size + 1)
                totals = best[k - 1, starts] + segment_cost(x, sums, starts, e, cost)
                j = int(np.argmin(totals))
                best[k, e], back[k, e] = totals[j], starts[j]
        out, e = [], n
        if not np.isfinite(best[n_bkps, n]):
            return []
        for k in range(n_bkps, 0, -1):
            e = int(back[k, e])
            out.append(e)
        return out[::-1]
    found: list[int] = []
    if model == "binseg":
        parts = [(*gain(x, sums, 0, n, cost, min_size), 0, n)]
        while parts:
            k = max(range(len(parts)), key=lambda i: parts[i][0])
            saved, cut, a, b = parts.pop(k)
            if cut < 0 or (len(found) >= n_bkps if n_bkps is not None else saved <= beta):
                break
            found.append(cut)
            parts += [(*gain(x, sums, a, cut, cost, min_size), a, cut), (*gain(x, sums, cut, b, cost, min_size), cut, b)]
    elif model == "bottomup":
        edges = [0, *range(min_size, n - min_size + 1, min_size), n]
        while len(edges) > 2:
            extra = [one(a, c) - one(a, b) - one(b, c) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)]
            k = int(np.argmin(extra))
            if len(edges) - 2 <= n_bkps if n_bkps is not None else extra[k] > beta:
                break
            del edges[k + 1]
        found = edges[1:-1]
    elif model == "window":
        half = max(min_size, min(width, n // 2) // 2)
        at = np.arange(half, n - half + 1)
        saved = np.array([one(i - half, i + half) - one(i - half, i) - one(i, i + half) for i in at])
        order = np.argsort(-saved, kind="stable")
        for k in order:
            if len(found) >= n_bkps if n_bkps is not None else saved[k] <= beta:
                break
            if all(abs(at[k] - f) >= half for f in found):
                found.append(int(at[k]))
    else:
        raise ValueError(f"unknown search {model!r}")
    return sorted(found)


def change_sizes(x: np.ndarray, changes: list[int]) -> np.ndarray:
    """At each change the distance of the levels on either side, 0 elsewhere."""
    out = np.zeros(len(x))
    edges = [0, *changes, len(x)]
    levels = [float(np.nanmean(x[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
    for c, a, b in zip(changes, levels, levels[1:], strict=False):
        out[c] = abs(b - a)
    return out


# spectral residual


def spectral_residual(x: np.ndarray, window: int = 3, series_window: int = 21, score_window: int = 21) -> np.ndarray:
    """Saliency of the residual log spectrum, against its own trailing mean."""
    ahead = 5
    n = len(x)
    if n < 3:
        return np.full(n, np.nan)
    look = max(1, min(series_window, n - 1))
    steps = np.arange(1, look + 1)
    slope = float(np.mean((x[-1] - x[-1 - steps]) / steps))
    extended = np.r_[x, np.full(ahead, x[-look] + slope * look if look < n else x[-1])]
    f = np.fft.fft(extended)
    amplitude = np.abs(f)
    log = np.log(np.where(amplitude > 1e-12, amplitude, 1e-12))
    residual = np.exp(log - trailing_mean(log, window))
    phase = np.where(amplitude > 1e-12, f / np.where(amplitude > 1e-12, amplitude, 1.0), 0.0)
    saliency = np.abs(np.fft.ifft(residual * phase))[:n]
    level = trailing_mean(saliency, score_window)
    return np.where(level > 0, (saliency - level) / np.where(level > 0, level, 1.0), 0.0)


# subsequence distances


def distance_profile(x: np.ndarray, m: int, i: int, mean: np.ndarray, sd: np.ndarray, normalize: bool, dots: np.ndarray) -> np.ndarray:
    if not normalize:
        squares = np.r_[0.0, np.cumsum(x * x)]
        own = squares[m:] - squares[:-m]
        return np.sqrt(np.maximum(own + own[i] - 2 * dots, 0.0))
    flat = sd < 1e-12
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (dots - m * mean * mean[i]) / (m * sd * sd[i])
    d = np.sqrt(np.maximum(2 * m * (1 - np.clip(r, -1, 1)), 0.0))
    if flat[i]:
        return np.where(flat, 0.0, math.sqrt(m))
    return np.where(flat, math.sqrt(m), d)


def nearest_distances(x: np.ndarray, m: int, normalize: bool = True, left: bool = False) -> np.ndarray:
    """Distance of every subsequence to its nearest one outside an exclusion zone of a quarter of its length; with
    ``left``, to its nearest one that ends before it begins.  Infinite where there is none."""
    n = len(x) - m + 1
    x = x - x.mean()
    sums, squares = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(x * x)]
    mean = (sums[m:] - sums[:-m]) / m
    sd = np.sqrt(np.maximum((squares[m:] - squares[:-m]) / m - mean * mean, 0.0))
    zone = math.ceil(m / 4)
    out = np.full(n, np.inf)
    first = np.correlate(x, x[:m], "valid")
    dots = first.copy()
    for i in range(n):
        if i:  # sliding dot products: one new and one old product each
            dots[1:] = dots[:-1] - x[: n - 1] * x[i - 1] + x[m : m + n - 1] * x[i + m - 1]
            dots[0] = first[i]
        d = distance_profile(x, m, i, mean, sd, normalize, dots)
        if left:
            if i >= m:
                out[i] = d[: i - m + 1].min()
        else:
            d[max(0, i - zone) : i + zone + 1] = np.inf
            out[i] = d.min()
    if left and normalize:
        out[sd < 1e-12] = np.inf
    return out


def covering_max(d: np.ndarray, n: int, m: int) -> np.ndarray:
    """For each point the largest of the finite distances of the subsequences that cover it."""
    out = np.full(n, np.nan)
    for k in range(m):
        at = np.arange(len(d)) + k
        np.fmax.at(out, at, np.where(np.isfinite(d), d, np.nan))
    return out


# seasonal-trend decomposition by loess


def loess(y: np.ndarray, q: int, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Local lines over the ``q`` nearest of evenly spaced values, tricube and given weights."""
    n = len(y)
    x = np.arange(n, dtype=float)
    out = np.empty(len(at))
    for j, t in enumerate(at):
        low = int(min(max(math.ceil(t - q / 2), 0), max(n - q, 0)))
        high = min(low + q, n)
        far = max(t - x[low], x[high - 1] - t)
        if q > n:
            far += (q - n) // 2
        d = np.abs(x[low:high] - t) / (far if far > 0 else 1.0)
        w = np.clip(1 - d**3, 0, None) ** 3 * weights[low:high]
        total = w.sum()
        if total <= 0:
            out[j] = y[low:high].mean()
            continue
        w = w / total
        centre = (w * x[low:high]).sum()
        spread = (w * (x[low:high] - centre) ** 2).sum()
        if math.sqrt(spread) > 0.001 * (n - 1 if n > 1 else 1):
            w = w * (1 + (t - centre) * (x[low:high] - centre) / spread)
        out[j] = (w * y[low:high]).sum()
    return out


def moving_mean(x: np.ndarray, w: int) -> np.ndarray:
    c = np.r_[0.0, np.cumsum(x)]
    return (c[w:] - c[:-w]) / w


def odd(n: float) -> int:
    k = math.ceil(n)
    return k + (k % 2 == 0)


def stl(x: np.ndarray, period: int, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal part, trend and remainder (Cleveland et al. 1990)."""
    n = len(x)
    low_pass = odd(period + (period % 2 == 0) - 0.0) if period % 2 else period + 1
    trend_q = odd(1.5 * period / (1 - 1.5 / seasonal))
    inner, outer = (2, 15) if robust else (5, 0)
    trend, rho, s = np.zeros(n), np.ones(n), np.zeros(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            detrended = x - trend
            cycle = np.zeros(n + 2 * period)
            for p in range(period):
                sub = detrended[p::period]
                at = np.arange(-1, len(sub) + 1, dtype=float)
                smooth = loess(sub, seasonal, rho[p::period], at)
                cycle[p : p + period * len(at) : period] = smooth
            level = moving_mean(moving_mean(moving_mean(cycle, period), period), 3)
            level = loess(level, low_pass, np.ones(len(level)), np.arange(len(level), dtype=float))
            s = cycle[period : period + n] - level[:n]
            trend = loess(x - s, trend_q, rho, np.arange(n, dtype=float))
        if turn < outer:
            r = np.abs(x - s - trend)
            h = 6 * np.median(r)
            rho = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h if h > 0 else r) ** 2) ** 2, 0.0)) if h > 0 else np.ones(n)
    return s, trend, x - s - trend


def mstl(x: np.ndarray, periods: list[int], windows: list[int], robust: bool = True, rounds: int = 2) -> np.ndarray:
    """Remainder after several seasonal parts, each refined in turn."""
    parts = {p: np.zeros(len(x)) for p in periods}
    rest, trend = x.copy(), np.zeros(len(x))
    for _ in range(rounds if len(periods) > 1 else 1):
        for p, w in zip(periods, windows, strict=True):
            rest = rest + parts[p]
            parts[p], trend, _ = stl(rest, p, w, robust)
            rest = rest - parts[p]
    return rest - trend
