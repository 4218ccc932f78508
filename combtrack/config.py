"""What one recording season fixes: image geometry, clock and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class HiveConfig:
    # Fixed values of the recordings.
    xpixels: int = 3296
    ypixels: int = 5652
    div_right: tuple[int, int] = (1890, 3680)
    div_left: tuple[int, int] = (1850, 3640)
    left_yshift: int = 40
    fps: int = 3
    pixels_per_cm: int = 80
    pixels_per_bin: int = 160
    exit_frame: tuple[int, int, int, int] = (3500, 6500, 3800, 5400)
    dance_floor: tuple[int, int, int, int] = (4700, 6000, 4350, 5200)
    first_day: str = "2024-01-01"
    #: Positions are divided by it, so that they fit the maps of the comb.
    scale: float = 1.0

    @property
    def frames_per_day(self) -> int:
        return self.fps * 86_400

    @property
    def x_bins(self) -> int:
        return round(2 * self.xpixels / self.pixels_per_bin)

    @property
    def y_bins(self) -> int:
        return round(self.ypixels / self.pixels_per_bin)

    @property
    def max_speed(self) -> int:
        """Pixels a second beyond which a step is an error of the detector."""
        return 3 * self.pixels_per_bin


HIVE_2018 = HiveConfig()
HIVE_2019 = replace(HIVE_2018, ypixels=5720, scale=1.16)
