"""labelsift: a Spark-native screen for label-flip poisoning of text corpora.

Every operator takes and returns a DataFrame that carries an explicit row key.
Results do not depend on partitioning: all randomness is a hash of
(seed, key), never a row position or a task id.
"""

from labelsift.session import ensure_checkpoint_dir, get_spark, materialize

__all__ = ["ensure_checkpoint_dir", "get_spark", "materialize"]
