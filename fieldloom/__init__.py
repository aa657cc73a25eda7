"""fieldloom: particle, halo and gridded-field analytics expressed as Spark jobs."""
