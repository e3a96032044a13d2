"""Document analytics on Spark: text, retrieval, security, settlement and evaluation operators as DataFrame plans."""
