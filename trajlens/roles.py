"""Which columns of a table play the entity, time and label roles."""

from __future__ import annotations

from dataclasses import dataclass

# Default column names and columns never used as features.
DEFAULT_ENTITY = "vehicle_id"
DEFAULT_TIME = "time_step"
DEFAULT_LABEL = "y_true"
TARGET_LIKE_COLUMNS = ("y_true", "class_label", "in_study_repair")


@dataclass(frozen=True)
class Roles:
    entity: str = DEFAULT_ENTITY
    time: str = DEFAULT_TIME
    label: str = DEFAULT_LABEL

    @property
    def non_features(self) -> tuple[str, ...]:
        return (self.entity, self.time, self.label, *TARGET_LIKE_COLUMNS)
