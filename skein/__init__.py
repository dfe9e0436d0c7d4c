"""skein: a PySpark-native engine for static analysis of agent artefacts and for training-data pipelines."""
