"""notefold: a PySpark-native engine for question-answer data about short event sequences."""
