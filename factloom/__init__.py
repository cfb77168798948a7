"""factloom: document-obligation analytics expressed as Spark DataFrame plans."""
