"""A workbook analytics engine expressed as Spark DataFrame plans."""
