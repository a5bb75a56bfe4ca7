"""Curation of DNA-barcode specimen records as Spark DataFrame jobs."""
