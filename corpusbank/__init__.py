"""corpusbank: document and question-bank analytics as PySpark DataFrame operators."""
