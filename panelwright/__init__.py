"""Panel analytics on Spark: sources, cleaning, resolution, panel building, quality and models.

Every public function takes and returns DataFrames, keeps no global state and
leaves physical planning to Catalyst.
"""

__version__ = "0.1.0"
