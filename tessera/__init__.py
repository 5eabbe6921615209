"""tessera: Spark-native search and analytics over collections of source files and documents."""
