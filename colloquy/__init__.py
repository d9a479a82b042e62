"""Meeting and text analytics expressed as Spark plans."""
