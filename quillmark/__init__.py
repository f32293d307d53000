"""quillmark: curation, scoring and evaluation of training records on Spark."""
