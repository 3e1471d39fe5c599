"""starling: vector similarity search and its analytics as Spark plans."""
