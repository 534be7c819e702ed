"""Spark-native analytics for mapping solar capacity from tabular satellite products.

Every public function takes and returns DataFrames; nothing runs until an action does.
"""
