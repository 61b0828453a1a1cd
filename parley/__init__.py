"""parley: dialogue evaluation as Spark DataFrame operators.

Every public operator takes and returns DataFrames; expressions in
``parley.functions`` return Columns that stay inside whole-stage codegen.
"""

from parley.session import build_session, read_table, scratch_dir

__all__ = ["build_session", "read_table", "scratch_dir"]
