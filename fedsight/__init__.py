"""fedsight — feature tables, partition-wise training, batch explanations and
cross-client importance analytics as Spark DataFrame operators.

Every public operator takes Spark DataFrames plus column names / parameters and
returns a lazy DataFrame; nothing is collected unless the operator's contract is
a small parameter (a weight vector, a list of category values) and its size is
bounded and checked.
"""

from fedsight.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
