"""lodestep: Spark-native analytics over corpora of step-by-step solutions."""
