"""Counterpoise: imbalanced-classification studies as Spark DataFrame operators."""

from counterpoise.task import Task, TaskSet
from counterpoise.sources.tables import task

__all__ = ["Task", "TaskSet", "task"]
