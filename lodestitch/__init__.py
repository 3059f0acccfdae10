"""lodestitch: document-segment and job analytics expressed as Spark plans."""
