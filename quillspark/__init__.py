"""quillspark: a document knowledge engine expressed as Spark DataFrame plans."""
