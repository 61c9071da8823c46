"""meguri: a PySpark-native analytics engine for multilingual, geo-tagged knowledge data.

The optional subpackage ``meguri.llm`` holds operators for preparing training
data; nothing outside that subpackage imports it.
"""

__version__ = "0.1.0"
