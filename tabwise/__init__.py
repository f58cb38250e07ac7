"""tabwise: tabular analytics and machine learning expressed as Spark jobs.

Every operator is a function from DataFrame to DataFrame (or to a fitted model,
or to a small driver-side parameter object such as a scaler's min/max).  The
heavy lifting always runs on Spark: aggregations with partial (map-side)
combine, exchanges keyed on hash buckets rather than on raw labels, and
expressions that stay inside whole-stage codegen.
"""

from tabwise.errors import PipelineError
from tabwise.session import build_session, ensure_checkpoint_dir

__all__ = ["PipelineError", "build_session", "ensure_checkpoint_dir"]
