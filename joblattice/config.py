"""Choices that are this library's own and may be tuned."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MatchSettings:
    """Weights of the 0-100 relevance score."""

    skill_points: int = 60
    same_band_points: int = 20
    near_band_points: int = 10
    mode_points: int = 10
    place_points: int = 10

    @property
    def points_beside_skills(self) -> int:
        return self.same_band_points + self.mode_points + self.place_points


@dataclass(frozen=True)
class RateLimit:
    """More than ``limit`` requests of one user in one window are flagged."""

    limit: int = 3
    window: str = "1 day"
    lateness: str = "1 hour"


MATCH = MatchSettings()
RATE = RateLimit()

# Rows of one hot key are spread over this many sub-keys where a join is
# followed by an aggregate on the same key (AQE does not split those).
SALT_BUCKETS = 16

# Longest piece of a saved search term that is used as its lookup key.
GRAM_LENGTH = 4

# Folders of the table of alerts sent, by a hash of the listing.
ALERT_BUCKETS = 64

SECRET_CONF = "spark.joblattice.secret.key"
