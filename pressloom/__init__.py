"""pressloom: analytics over multilingual news streams, expressed as Spark plans."""
