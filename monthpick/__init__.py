"""monthpick — point-in-time monthly opportunity selection on Spark.

Every public function is DataFrame-in / DataFrame-out and builds one lazy plan
covering all target months at once (the month is a group key, never a driver
loop).  Sub-packages:

* ``sources``    — adapters over the driver tables, typed loaders, file helpers, sinks
* ``functions``  — Column-level helpers (month codec, safe ratios, predicates)
* ``operators``  — labels, features, selection, evaluation, classifier metrics,
                   diagnostics, folds, MLlib models, SMOTE
* ``plans``      — end-to-end jobs: rule-based run, backtest, walk-forward
                   training, model comparison, rescoring
"""

from monthpick.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
