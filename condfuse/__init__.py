"""Condition-aware ensemble weighting over error cubes, on Spark.

Public entry points: ``condfuse.plans.protocol`` (fit / apply / evaluate /
sweep), ``condfuse.operators`` (building blocks), ``condfuse.sources``
(cube and flag readers, stand-ins) and ``condfuse.model.Protocol``.
"""

from condfuse.model import Protocol, ProtocolError

__all__ = ["Protocol", "ProtocolError"]
