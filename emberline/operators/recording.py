"""Whole recordings: timelines, spectra and band powers that all feature families share.

Everything is worked out for many points of a recording at once.  Stretches
around the points become rows of a padded array, whose places outside the
recording are NaN; spectra and band powers of a frame are computed once,
whichever points and families ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .frames import FLOOR, LEAST_MAD, LOUD, MAD_SCALE
from .signal import RATE, canonical, envelope, filter_section, high_pass, weighted

# Samples of a 50 ms and of a 10 ms row, and band edges in Hz.
ROW, FINE, EDGES = 800, 160, (70, 250, 500, 1000, 2000, 4000, 8000)
ROW_S, BINS = ROW / RATE, 513
#: Frames that are transformed together.
TOGETHER = 2048


def to_db(power: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(power, 1e-9))


def to_power(db: np.ndarray) -> np.ndarray:
    return 10 ** (np.asarray(db, float) / 10)


def stretches(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of ``x[first:last]`` for each pair, as far as it exists, NaN beyond."""
    first, last = np.maximum(first, 0), np.clip(last, 0, len(x))
    at = first[:, None] + np.arange(max(1, int((last - first).max(initial=0))))
    return np.where(at < last[:, None], np.append(x, np.nan)[np.minimum(at, len(x))], np.nan)


def sizes(rows: np.ndarray) -> np.ndarray:
    return np.isfinite(rows).sum(axis=1)


def quantiles(rows: np.ndarray, percent: float, nothing: float = FLOOR) -> np.ndarray:
    """Interpolated percentile of each row without its NaN; ``nothing`` for rows of NaN."""
    n = sizes(rows)
    place = np.maximum(n - 1, 0) * percent / 100
    low = np.floor(place).astype(int)
    ordered, each = np.sort(rows, axis=1), np.arange(len(rows))
    a, b = ordered[each, low], ordered[each, np.minimum(low + 1, np.maximum(n - 1, 0))]
    return np.where(n > 0, a + (b - a) * (place - low), nothing)


def means(rows: np.ndarray, nothing: float) -> np.ndarray:
    n = sizes(rows)
    return np.where(n > 0, np.nansum(rows, axis=1) / np.maximum(n, 1), nothing)


class Timelines:
    """``level`` and ``fine`` (dB, 50 and 10 ms a row) of the weighted samples, ``clipped``
    (each row's share of samples near full scale) and the greatest sample; samples are
    ``(n, channels)`` of at least 0.3 s."""

    def __init__(self, samples: np.ndarray):
        n = len(samples) // ROW
        if n < 6:
            raise ValueError("a recording has at least 0.3 s")
        power = (weighted(samples[: n * ROW].T.astype(np.float64)) ** 2).mean(axis=0)
        fine = power.reshape(-1, FINE).mean(axis=1)
        self.level, self.fine = (np.maximum(FLOOR, to_db(p) - 0.691) for p in (fine.reshape(-1, ROW // FINE).mean(axis=1), fine))
        size = np.abs(samples[: n * ROW]).reshape(n, -1)
        self.clipped, self.greatest, self.seconds = (size >= 10 ** (-1 / 20)).mean(axis=1), float(size.max()), len(samples) / RATE


class Spectra:
    """Normalised power spectra of a recording's 50 ms rows, each made once; rows that
    are not whole are flat.  Takes samples ``(n, channels)``, or spectra that are known."""

    def __init__(self, samples: np.ndarray | None = None, known: np.ndarray | None = None):
        self.samples = samples
        self.known = np.zeros((0, BINS)) if known is None else known
        self.bins = self.known.shape[1]
        self.place = np.full(len(samples) // ROW, -1) if known is None else np.arange(len(known))
        self.hz = np.fft.rfftfreq(2 * (self.bins - 1), 1 / RATE)

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        """Spectra of the rows with these numbers, in their order."""
        inside = numbers < len(self.place)
        if self.samples is not None:
            new = np.unique(numbers[inside])
            new = new[self.place[new] < 0]
            made = [self.known]
            for at in range(0, len(new), TOGETHER):
                cut = self.samples[new[at : at + TOGETHER, None] * ROW + np.arange(ROW)] * np.hanning(ROW)[:, None]
                power = (np.abs(np.fft.rfft(cut, 2 * (BINS - 1), axis=1)) ** 2).mean(axis=2) + 1e-12
                made.append(power / power.sum(axis=1, keepdims=True))
            self.place[new] = len(self.known) + np.arange(len(new))
            self.known = np.concatenate(made)
        out = np.full((len(numbers), self.bins), 1 / self.bins)
        out[inside] = self.known[self.place[numbers[inside]]]
        return out

    def ranges(self, first: np.ndarray, last: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """All row numbers of ``range(first, last, step)`` for each pair, and how many each has."""
        counts = np.maximum(0, -((first - last) // step))
        begin = np.cumsum(counts) - counts
        return np.repeat(first, counts) + step * (np.arange(counts.sum()) - np.repeat(begin, counts)), counts

    def mixtures(self, first: np.ndarray, last: np.ndarray, step: int = 1) -> np.ndarray:
        """Mean spectrum of ``range(first, last, step)`` for each pair; of no rows, a flat one."""
        numbers, counts = self.ranges(first, last, step)
        out = np.full((len(first), self.bins), 1 / self.bins)
        some = counts > 0
        if some.any():
            begin = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(self.rows(numbers), begin, axis=0) / counts[some, None]
        return out / out.sum(axis=1, keepdims=True)


def hellinger(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum(axis=-1) / 2)


def band_masks(hz: np.ndarray) -> np.ndarray:
    """One column of ones and zeros for each band."""
    return np.stack([(hz >= a) & (hz < b) for a, b in zip(EDGES, EDGES[1:], strict=False)], axis=1).astype(float)


def spectral(spectra: Spectra, row: np.ndarray, rows: int) -> dict[str, np.ndarray]:
    """How the spectrum changes at each row: shape, flatness, centroid, bands, flux."""
    was = spectra.mixtures(np.maximum(0, row - 42), np.maximum(0, row - 2), 2)
    now = spectra.mixtures(row, np.minimum(rows, row + 6))
    flatness = lambda p: np.exp(np.log(p + 1e-12).mean(axis=1)) / p.mean(axis=1)
    out = {"spectral_shape_distance": hellinger(now, was), "spectral_flatness_delta": flatness(now) - flatness(was), "spectral_centroid_delta_hz": (now - was) @ spectra.hz}
    inside = band_masks(spectra.hz)
    jumps = 10 * np.log10((now @ inside + 1e-9) / (was @ inside + 1e-9))
    out |= {f"band_{a}_{b}_jump_db": jumps[:, k] for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False))}
    # rises from one row to the next, for the five around each row
    around = row[:, None] + np.arange(-3, 3)
    near = spectra.rows(np.maximum(0, around).ravel()).reshape(len(row), 6, -1)
    rises = np.maximum(np.diff(near, axis=1), 0).sum(axis=2)
    exists = (around[:, 1:] >= 1) & (around[:, 1:] < rows)
    out["spectral_flux"] = np.where(row > 0, rises[:, 2], 0.0)
    out["nearby_spectral_flux"] = np.where(exists, rises, 0.0).max(axis=1)
    return out


def rhythms(fine: np.ndarray, point: np.ndarray, spectra: Spectra, row: np.ndarray) -> dict[str, np.ndarray]:
    """Periodicity of the rises in the eight seconds before each point, how its own rise
    compares with them, and the nearest of the spectra before it."""
    event = spectra.mixtures(row, np.minimum(row + 2, len(fine) // 5))
    numbers, counts = spectra.ranges(np.maximum(0, row - 160), np.maximum(0, row - 10), 5)
    nearest, some = np.full(len(row), np.nan), counts > 0
    if some.any():
        nearest[some] = np.minimum.reduceat(hellinger(np.repeat(event, counts, axis=0), spectra.rows(numbers)), (np.cumsum(counts) - counts)[some])
    periodic = np.full(len(point), np.nan)
    before = stretches(fine, point - 800, point)
    rises = np.maximum(np.diff(before, axis=1), 0) / (1 + np.exp(-np.clip((before[:, 1:] + 25) / 6, -30, 30)))
    for k, n in enumerate(sizes(rises)):
        if n >= 60:
            x = rises[k, :n]
            lags = np.arange(20, min(151, n // 2))
            energy = np.concatenate([[0.0], np.cumsum(x * x)])
            scale = np.sqrt(energy[n - lags]) * np.sqrt(np.maximum(energy[n] - energy[lags], 0))
            alike = np.correlate(x, x, "full")[n - 1 + lags]
            periodic[k] = np.max(np.where(scale > 1e-8, alike / np.maximum(scale, 1e-8), 0.0), initial=0.0)
    usual = quantiles(rises, 95, 0.0)
    steps = np.diff(stretches(fine, point - 5, point + 20), axis=1)
    sharpest = np.where(np.isfinite(steps).any(axis=1), np.where(np.isfinite(steps), steps, -np.inf).max(axis=1, initial=-np.inf), 0.0)
    return {
        "rhythm_onset_periodicity": periodic, "rhythm_onset_surprise_ratio": np.minimum(30.0, sharpest / np.maximum(1.0, usual)),
        "rhythm_previous_onset_p95_db": usual, "rhythm_previous_spectral_distance_min": nearest,
    }


class BandPowers:
    """One-sided power of each band in frames of 512 samples, each made once."""

    size, hop = 512, 160

    def __init__(self, samples: np.ndarray):
        self.samples, self.window = samples, np.hanning(self.size)
        sides = np.full(self.size // 2 + 1, 2.0)
        sides[[0, -1]] = 1.0
        self.to_bands = band_masks(np.fft.rfftfreq(self.size, 1 / RATE)) * (sides / (self.size * (self.window**2).sum()))[:, None]

    def at(self, starts: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(starts, return_inverse=True)
        out = np.empty((len(distinct), len(EDGES) - 1))
        for k in range(0, len(distinct), TOGETHER):
            cut = self.samples[distinct[k : k + TOGETHER, None] + np.arange(self.size)].astype(float) * self.window[:, None]
            out[k : k + TOGETHER] = (np.abs(np.fft.rfft(cut, axis=1)) ** 2).mean(axis=2) @ self.to_bands
        return out[place]

    def features(self, at: np.ndarray) -> dict[str, np.ndarray]:
        """Each band's 90th percentile in the 0.3 s from each time on, and its jump over the
        median of what lies 50 ms to one second before it; NaN where there are no 512 samples."""
        first = np.maximum(0, np.rint((at - 1.0) * RATE).astype(int))
        frames = np.maximum(0, (np.minimum(len(self.samples), np.rint((at + 0.4) * RATE).astype(int)) - first - self.size) // self.hop + 1)
        grid = first[:, None] + self.hop * np.arange(max(1, frames.max(initial=0)))
        there = np.arange(grid.shape[1]) < frames[:, None]
        db = np.full((*grid.shape, len(EDGES) - 1), np.nan)
        if there.any():
            db[there] = to_db(self.at(grid[there]))
        middle = (grid + self.size // 2) / RATE
        before, during = there & (middle < at[:, None] - 0.05), there & (middle >= at[:, None]) & (middle < at[:, None] + 0.3)
        out = {}
        for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
            top = np.where(frames > 0, quantiles(np.where(during, db[:, :, k], np.nan), 90), np.nan)
            out[f"bands_event_db_{a}_{b}"] = top
            out[f"bands_jump_db_{a}_{b}"] = top - quantiles(np.where(before, db[:, :, k], np.nan), 50, np.nan)
        return out


def slowed(x: np.ndarray, by: int = 32) -> np.ndarray:
    """Every ``by``-th sample of each row after a low-pass of ``20 * by + 1`` taps under a Kaiser window."""
    half = 10 * by
    taps = np.sinc(np.arange(-half, half + 1) / by) * np.kaiser(2 * half + 1, 5.0)
    n = 1 << (x.shape[1] + len(taps) - 1).bit_length()
    spread = np.fft.irfft(np.fft.rfft(x, n, axis=1) * np.fft.rfft(taps / taps.sum(), n), n, axis=1)
    return spread[:, half : half + x.shape[1] : by]


def modulations(samples: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch the share of its envelope's 4-200 Hz power that lies in 30-150 Hz,
    and the envelope's relative deviation; NaN under 0.2 s, 0 for silence.

    The envelope is that of the strongest channel over 250 Hz, at 500 Hz.
    Stretches of equal length are worked out together.
    """
    share, depth = np.full(len(first), np.nan), np.full(len(first), np.nan)
    first, last = np.maximum(first, 0), np.clip(last, 0, len(samples))
    for n in np.unique(last - first).tolist():
        if n < RATE // 5:
            continue
        of = np.flatnonzero(last - first == n)
        cut = samples[first[of][:, None] + np.arange(n)].astype(float)
        strongest = (cut[:, ::16] ** 2).mean(axis=1).argmax(axis=1)
        high = filter_section(np.take_along_axis(cut, strongest[:, None, None], axis=2)[:, :, 0], high_pass(250.0))[0]
        slow = slowed(np.stack([envelope(row) for row in high]))
        level = slow.mean(axis=1)
        hz = np.fft.rfftfreq(slow.shape[1], 1 / 500)
        power = np.abs(np.fft.rfft((slow - level[:, None]) * np.hanning(slow.shape[1]), axis=1)) ** 2
        rough, all_of = (power @ ((hz >= a) & (hz <= b)).astype(float) for a, b in ((30, 150), (4, 200)))
        loud = level >= 1e-7
        share[of], depth[of] = np.where(loud, rough / np.maximum(all_of, 1e-20), 0.0), np.where(loud, slow.std(axis=1) / np.maximum(level, 1e-7), 0.0)
    return share, depth


def roughnesses(samples: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Modulation before and from each time on, and their differences."""
    place = lambda s: np.maximum(0, np.rint((at + s) * RATE).astype(int))
    (share_was, depth_was), (share, depth) = modulations(samples, place(-0.7), place(-0.1)), modulations(samples, place(0.0), place(0.6))
    return {"roughness_before_ratio": share_was, "roughness_event_ratio": share, "roughness_ratio_delta": share - share_was, "roughness_event_depth": depth, "roughness_depth_delta": depth - depth_was}


def holding(level: np.ndarray, row: np.ndarray, least: np.ndarray, limit: int = 120) -> np.ndarray:
    """Seconds from each row to the last level of at least ``least`` before two misses in a row."""
    hit = stretches(level, row, row + limit) >= least[:, None]
    missed_twice = ~hit & np.concatenate([np.zeros((len(row), 1), bool), ~hit[:, :-1]], axis=1)
    open_ = np.cumsum(missed_twice, axis=1) == 0
    held = hit & open_
    return np.where(held.any(axis=1), hit.shape[1] - held[:, ::-1].argmax(axis=1), 0) * ROW_S


def separate(rank: np.ndarray, rows: np.ndarray, taken: list[int], apart: int, most: int, above: float = -np.inf) -> list[int]:
    """Up to ``most`` rows by falling rank, first ones first, each ``apart`` or more from all taken before it."""
    chosen: list[int] = []
    for k in np.argsort(-rank, kind="stable").tolist():
        if len(chosen) == most or rank[k] <= above:
            break
        if all(abs(int(rows[k]) - t) >= apart for t in (*taken, *chosen)):
            chosen.append(int(rows[k]))
    return chosen


def weighed(rise: np.ndarray, db: np.ndarray, middle: float) -> np.ndarray:
    """Rises in dB, less of those that stay quiet."""
    return np.maximum(rise, 0) / (1 + np.exp(-np.clip((db - middle) / 6, -30, 30)))


def mean_db(fine_power: np.ndarray, first: np.ndarray, last: np.ndarray, least: int = 1) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(fine_power)])
    return to_db((sums[last] - sums[first]) / np.maximum(least, last - first))


def proposals(level: np.ndarray, first: int) -> list[int]:
    """Rows that may begin an event, from ``first`` on: the six steepest of one row and of
    six rows against the three seconds before, ten rows apart; the steepest of each 20 s
    if it is clear of these; and the loudest of the first second."""
    rows = np.arange(first, len(level))
    if len(rows) < 2:
        return [first]
    power = to_power(level)
    before = mean_db(power, np.maximum(0, rows - 60), np.maximum(0, rows - 1))
    ranks = []
    for width in (1, 6):
        db = mean_db(power, rows, np.minimum(len(level), rows + width))
        ranks.append(weighed(db - before, db, -24))
    chosen: list[int] = []
    for rank in ranks:
        chosen += separate(rank, rows, chosen, 10, 6)
    best = np.maximum(*ranks)
    for at in range(0, len(rows), 400):
        row = first + at + int(best[at : at + 400].argmax())
        if all(abs(row - c) >= 3 for c in chosen):
            chosen.append(row)
    return sorted({*chosen, first + int(level[first : first + 20].argmax())})


def short_onsets(fine: np.ndarray, originals: list[float], most: int = 4) -> list[float]:
    """Seconds, in steps of 50 ms, of up to four peaks of 50 ms against the half second
    before, 0.15 s clear of the original events and half a second of each other."""
    at = np.arange(15, len(fine) - 5)
    if not len(at):
        return []
    power = to_power(fine)
    before, db = mean_db(power, np.maximum(0, at - 55), at - 5), mean_db(power, at, at + 5)
    rank = weighed(db - before, db, -20)
    chosen: list[float] = []
    for k in np.argsort(-rank, kind="stable").tolist():
        if rank[k] <= 0 or len(chosen) == most:
            break
        second = round(int(at[k]) / 5) * ROW_S
        if all(abs(second - o) >= 0.15 for o in originals) and all(abs(second - c) >= 0.5 for c in chosen):
            chosen.append(second)
    return chosen


def candidates(level: np.ndarray, most: int = 3, apart: int = 20) -> list[int]:
    """Rows with a whole second before them that stand out most, by level, jump and deviation."""
    rows = np.arange(22, len(level) - 5)
    if not len(rows):
        return []
    before = stretches(level, rows - 60, rows - 2)
    base = quantiles(before, 50)
    spread = quantiles(np.abs(before - base[:, None]), 50)
    event = quantiles(stretches(level, rows, rows + 6), 25)
    jump = event - base
    s = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    score = s((event + 10.5) / 2.5) ** 0.9 * s((jump - 13) / 3.5) ** 1.25 * (0.65 + 0.35 * s((jump / np.maximum(LEAST_MAD, MAD_SCALE * spread) - 6) / 2))
    return separate(score, rows, [], apart, most)


def chunks_together(batches: Iterator, key: str, samples: str, channels: str | None = None) -> Iterator[tuple[object, np.ndarray]]:
    """Whole recordings ``key, (n, channels)`` of chunks in order, which batches may cut
    anywhere; ``channels`` names a column of their number, all have one without it."""
    own, parts, width = None, [], 1
    for batch in batches:
        keys, lists = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index(samples))
        counts = batch.column(batch.schema.get_field_index(channels)).to_pylist() if channels else [1] * len(keys)
        for k, (name, count) in enumerate(zip(keys, counts, strict=True)):
            if parts and name != own:
                yield own, np.concatenate(parts).reshape(-1, width)
                parts = []
            own, width = name, count or 1
            held = lists[k]
            parts.append(held.values.to_numpy(zero_copy_only=False).astype(np.float32) if held.is_valid else np.zeros(0, np.float32))
    if parts:
        yield own, np.concatenate(parts).reshape(-1, width)


def silent(samples: np.ndarray, threshold: float = 1e-5) -> bool:
    return not (np.abs(samples) > threshold).any()


def trimmed(samples: np.ndarray, pad_s: float = 6.0) -> tuple[np.ndarray, float]:
    """Bounded samples ``(n, channels)`` without silence ahead and with padding in front,
    and what to add to a time in them to get one in the recording."""
    if not len(samples) or not np.isfinite(samples).all():
        raise ValueError("a recording has finite samples")
    x = np.clip(samples, -1.0, 1.0).astype(np.float32).T
    if silent(x):
        return np.zeros((int(pad_s * RATE) + RATE // 2, len(x)), np.float32), x.shape[1] / RATE - pad_s
    out, off = canonical(x, int(pad_s * RATE))
    return out.T, off / RATE - pad_s


__all__ = ["LOUD", "BandPowers", "Spectra", "Timelines", "candidates", "chunks_together", "holding", "means", "modulations", "proposals", "quantiles", "rhythms", "roughnesses", "short_onsets", "silent", "spectral", "stretches", "to_db", "to_power", "trimmed"]
