"""parcelframe — shipment analytics as Spark DataFrame operators.

Every operator takes a DataFrame (plus parameters) and returns a DataFrame.
Nothing is collected to the driver except small, bounded lists (pivot
values, model scalars); the heavy lifting is Spark SQL / DataFrame /
``pyspark.ml`` built-ins.
"""

__version__ = "0.1.0"
