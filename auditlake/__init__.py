"""auditlake: audit-log analytics for SQL databases, written as Spark jobs.

Text lines are parsed, classified and normalised with built-in column expressions; every report is
derived from two small aggregates (operations per second and pattern counts).
"""

from auditlake.profiles import AWK, PROFILES, PYTHON, SHELL, Profile
from auditlake.session import build_session, materialize

__all__ = ["AWK", "PROFILES", "PYTHON", "SHELL", "Profile", "build_session", "materialize"]
