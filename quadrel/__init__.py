"""quadrel: sparse Boolean matrices as distributed relations on Spark."""
