"""loomscore: dialogue-evaluation analytics expressed as Spark DataFrame operators."""
