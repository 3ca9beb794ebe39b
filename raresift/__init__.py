"""raresift: rare-event (fraud) detection analytics as Spark DataFrame jobs.

Layout
------
- ``sources``   readers, fixture views and sinks
- ``functions`` column-level helpers (hash uniforms, vector math, running totals)
- ``operators`` the operators of the inventory (scaling, splits, samplers,
  classifiers, anomaly scores, metrics, curves, model selection, reports)
- ``plans``     end-to-end flows built from the operators
- ``streaming`` the same scoring operators attached to ``readStream`` sources
"""

from raresift.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
