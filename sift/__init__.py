"""sift — Spark-native analytics over free-text survey comments.

Comments are cleaned with DataFrame expressions, turned into a long token
table ``(doc_id, pos, token)`` and a vector table ``(doc_id, embedding)``,
and every statistic, clustering and labelling step is a Spark plan over
those two relations.
"""

from sift.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
