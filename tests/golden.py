"""Catalog rows with known efforts and sizes."""

# Metadata of 21 published pipelines and the efforts computed from it by hand formulas.
TYPES = {"data_preprocessing": "preprocessing", "model_training": "training", "model_evaluation": "evaluation"}


def version(n, d=None, shape=None, types=None):
    return {"n_samples": n, "n_features": d, "input_shape": shape, "data_types": types}


def dense(*sizes):
    return [{"type": "Dense", "input_shape": [a], "output_shape": [b]} for a, b in zip(sizes, sizes[1:])]


def conv(i, o, k=(3, 3)):
    return {"type": "Conv2D", "input_shape": list(i), "output_shape": list(o), "kernel_size": list(k), "strides": [1, 1]}


def pool(i, o):
    return {"type": "MaxPooling2D", "input_shape": list(i), "output_shape": list(o), "pool_size": [2, 2]}


def other(kind, *shape):
    return {"type": kind, "input_shape": list(shape), "output_shape": list(shape)}


ADULT = (version(48842, 14, types={"int64": 6, "object": 9}), version(74218, 12, types={"int64": 10, "float64": 3}))
CREDIT = (version(30000, 24, types={"int64": 12, "float64": 13}), version(30000, 23, types={"int64": 11, "float64": 13}))
KDD = (version(494021, 41, types={"int64": 23, "object": 4, "float64": 15}), version(494021, 41, types={"int64": 27, "float64": 15}))
UNSW = (version(257673, 43, types={"float64": 11, "object": 3, "int64": 29}), version(257673, 41, types={"float64": 11, "int64": 32}))
WINE = (version(4898, 11, types={"int64": 1, "float64": 11}),) * 2
MNIST = (version(70000, shape=[28, 28, 1]),) * 2
CIFAR = (version(60000, shape=[32, 32, 3]),) * 2
CITRUS = (version(594, shape=[256, 256, 3]),) * 2

MNIST_CNN = [conv((28, 28, 1), (26, 26, 32)), pool((26, 26, 32), (13, 13, 32)), conv((13, 13, 32), (11, 11, 64)),
             pool((11, 11, 64), (5, 5, 64)), other("Flatten", 5, 5, 64), *dense(1600, 128, 10)]
CIFAR_CNN = [conv((32, 32, 3), (30, 30, 32)), pool((30, 30, 32), (15, 15, 32)), conv((15, 15, 32), (13, 13, 64)),
             pool((13, 13, 64), (6, 6, 64)), conv((6, 6, 64), (4, 4, 128)), pool((4, 4, 128), (2, 2, 128)), *dense(512, 128, 10)]
CIFAR_CNN2 = [conv((32, 32, 3), (30, 30, 32)), conv((30, 30, 32), (28, 28, 32)), pool((28, 28, 32), (14, 14, 32)),
              conv((14, 14, 32), (14, 14, 64)), conv((14, 14, 64), (12, 12, 64)), pool((12, 12, 64), (6, 6, 64)),
              conv((6, 6, 64), (6, 6, 128)), conv((6, 6, 128), (4, 4, 128)), pool((4, 4, 128), (2, 2, 128)),
              *dense(512, 1024, 512, 10)]
CITRUS_CNN = [conv((256, 256, 3), (254, 254, 32)), pool((254, 254, 32), (127, 127, 32)), conv((127, 127, 32), (125, 125, 64)),
              pool((125, 125, 64), (62, 62, 64)), conv((62, 62, 64), (60, 60, 128)), pool((60, 60, 128), (30, 30, 128)),
              other("Flatten", 30, 30, 128), *dense(115200, 128, 4)]

# name, data, model, parameters, (preprocessing, training, evaluation, total), (original KB, prepared KB)
GOLDEN = [
    ("wine_dt", WINE, "decision_tree", {"max_depth": 10}, (53878, 514413, 9790, 578081), (459, 459)),
    ("wine_lr", WINE, "logistic_regression", {"n_iter": 100}, (53878, 4309800, 10769, 4374447), (459, 459)),
    ("credit_dt", CREDIT, "decision_tree", {"max_depth": 10}, (720000, 8032012, 60000, 8812012), (5859, 5625)),
    ("adult_dt", ADULT, "decision_tree", {"max_depth": 10}, (683788, 11298309, 148430, 12130527), (5723, 7537)),
    ("credit_lr", CREDIT, "logistic_regression", {"n_iter": 100}, (720000, 55200000, 138000, 56058000), (5859, 5625)),
    ("adult_lr", ADULT, "logistic_regression", {"n_iter": 100}, (683788, 71248800, 178116, 72110704), (5723, 7537)),
    ("credit_rf", CREDIT, "random_forest", {"n_estimators": 100}, (720000, 772800000, 7530448.0712, 781050448.0712), (5859, 5625)),
    ("adult_rf", ADULT, "random_forest", {"n_estimators": 150, "max_depth": 20}, (683788, 1603098000, 44529000, 1648310788), (5723, 7537)),
    ("unsw_svm", UNSW, "svm", {"kernel": "linear", "n_iter": 1000}, (11079939, 8451658000, 2112894, 8464850833), (86562, 86562)),
    ("unsw_rf", UNSW, "random_forest", {"n_estimators": 100, "max_depth": 20}, (11079939, 14367818600, 103068000, 14481966539), (86562, 86562)),
    ("kdd_svm", KDD, "svm", {"kernel": "linear", "n_iter": 1000}, (20254861, 16203856000, 4050964, 16228161825), (162100, 162100)),
    ("kdd_rf", KDD, "random_forest", {"n_estimators": 100, "max_depth": 20}, (20254861, 29166940800, 197608000, 29384803661), (162100, 162100)),
    ("unsw_nn", UNSW, "nn", {"n_epochs": 10, "layers": dense(42, 128, 96, 64) + [other("Dropout", 64)] + dense(64, 2)},
     (11079939, 299633951280, 2496925368, 302141956587), (86562, 86562)),
    ("fashion_nn", MNIST, "nn", {"n_epochs": 10, "layers": dense(784, 128, 10)}, (54880000, 341947200000, 2849560000, 344851640000), None),
    ("mnist_nn", (version(70000, shape=[28, 28, 1], types={"uint8": 784}), version(70000, shape=[28, 28, 1], types={"float64": 784})),
     "nn", {"n_epochs": 10, "layers": [other("Flatten", 28, 28), *dense(784, 128), other("Dropout", 128), *dense(128, 10)]},
     (54880000, 341947200000, 2849560000, 344851640000), (53593, 428750)),
    ("credit_svm", CREDIT, "svm", {"kernel": "rbf"}, (720000, 1324800000000, 828000000, 1325628720000), (5859, 5625)),
    ("cifar_cnn", CIFAR, "cnn", {"n_epochs": 5, "layers": CIFAR_CNN}, (184320000, 7458154560000, 124302576000, 7582641456000), None),
    ("fashion_cnn", MNIST, "cnn", {"n_epochs": 10, "layers": MNIST_CNN}, (54880000, 8934945600000, 74457880000, 9009458360000), None),
    ("mnist_cnn", MNIST, "cnn", {"n_epochs": 10, "layers": MNIST_CNN}, (54880000, 8934945600000, 74457880000, 9009458360000), None),
    ("citrus_cnn", CITRUS, "cnn", {"n_epochs": 10, "layers": CITRUS_CNN}, (116785152, 17881419954000, 148070705584, 18029607444736), None),
    ("cifar_cnn2", CIFAR, "cnn", {"n_epochs": 10, "layers": CIFAR_CNN2}, (184320000, 66323894400000, 552699120000, 66876777840000), None),
]


def catalog_objects():
    """The rows as nested JSON objects in submission order."""
    for i, (name, (original, prepared), model, params, _, _) in enumerate(GOLDEN):
        kind = "image" if original["input_shape"] else "tabular"
        yield {
            "pipeline_id": name, "name": name, "submitted_at": f"2025-01-01T00:{i:02d}:00Z", "components_type": TYPES,
            "dataset": {"name": name, "type": kind, "train_percentage": 0.8, "val_percentage": 0, "test_percentage": 0.2,
                        "normalized": False, "original": original, "preprocessed": prepared},
            "model": {"type": model, "params": params},
        }
