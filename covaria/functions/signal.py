"""Wave-number grids, bell filters and the sub-band decomposition of images."""

from __future__ import annotations

import numpy as np

LIGHT = 3e8


def bell(x, a, b, c):
    """Generalised bell 1 / (1 + |(x - c) / a|^(2b))."""
    return 1 / (1 + np.abs((x - c) / a) ** (2 * b))


def wave_grid(rows: int, cols: int, bandwidth: float, range_resolution: float, azimuth_resolution: float, frequency: float):
    """Polar wave numbers (kappa, theta), each rows x cols. Range resolution is implied by the bandwidth."""
    kx = 2 * frequency / LIGHT + 2 * bandwidth / LIGHT * np.linspace(-0.5, 0.5, cols)
    top = 1 / (2 * azimuth_resolution)
    ky = np.linspace(-top, top * (1 - 1 / rows), rows)
    return np.hypot(kx[None, :], ky[:, None]), np.arctan2(ky[:, None], kx[None, :])


def filter_bank(kappa, theta, r: int, l: int, d_1: float, d_2: float) -> np.ndarray:
    """(r * l, rows, cols): products of two bells that tile the grid's ranges evenly."""
    def bands(v, n, d):
        low, width = v.min(), (v.max() - v.min()) / n
        return [bell(v, width / 2, d, low + width * (k + 0.5)) for k in range(n)]

    across = bands(theta, l, d_2)
    return np.stack([u * v for u in bands(kappa, r, d_1) for v in across])


def decompose(image: np.ndarray, bank: np.ndarray, convention: str = "mixed") -> np.ndarray:
    """Sub-bands (..., rows, cols, r * l) of images (..., rows, cols); one transform serves all filters.

    "mixed" undoes the centring by a forward shift, as users compare to; on odd sizes that moves the
    spectrum by one, which "consistent" does not.
    """
    axes = (-2, -1)
    spectrum = np.fft.fftshift(np.fft.fft2(image), axes)[..., None, :, :] * bank
    back = np.fft.fftshift if convention == "mixed" else np.fft.ifftshift
    return np.moveaxis(np.fft.ifft2(back(spectrum, axes)), -3, -1)
